"""Switches between the behaviour that users of such analyses see today and the behaviour that is documented."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Semantics:
    #: Components match on the last part after ``/`` or ``!``; else after ``/`` only, so nested jars never match.
    component_basename: bool = True
    #: Framework versions are sought on that last part too; else on the whole stored name.
    version_basename: bool = True
    #: Levels of archives inside archives; None for all.
    max_depth: int | None = 2
    #: Classes are told apart by archive and path; else by path, the outer archive's winning.
    class_key_archive: bool = False
    #: The outermost manifest counts; else the one visited last.
    outer_manifest: bool = False
    #: Routes are deduplicated by their normalised URL; else before normalisation.
    normalised_route_key: bool = False
    #: Spring Boot routes take the place of Spring MVC ones; else both stand.
    boot_supersedes_mvc: bool = False
    #: struts*.xml actions count as WebWork as well where WebWork is found.
    struts_as_webwork: bool = True
    #: All url-patterns of a mapping; else the last.
    all_url_patterns: bool = False
    #: ``commons-collections-`` has its dash; else that pattern never matches a real file name.
    fixed_commons_collections: bool = False
    #: Any Name: header opens a manifest section; else the first only.
    all_manifest_sections: bool = False
    #: Inner archives count wherever they lie, zips too; else jars and wars under ``lib/``.
    any_inner_archive: bool = False
    #: Source annotations belong to one overload; else to all methods of the name.
    overload_annotations: bool = False


DEFAULT = Semantics()


def reference() -> Semantics:
    """Bug for bug."""
    return replace(DEFAULT, component_basename=False, version_basename=False)


def documented() -> Semantics:
    """As documented, or as evidently meant."""
    return Semantics(True, True, None, True, True, True, True, False, True, True, True, True, True)

"""Class files: bytes to a row, and rows to bytes for fixtures."""

from __future__ import annotations

import re
import struct

#: Payload bytes after the tag of a constant, by tag; 1 is a string with its own length. Fixed values.
PAYLOAD = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
PRIMITIVES = dict(zip("BCDFIJSZV", "byte char double float int long short boolean void".split(), strict=True))
_TYPE = re.compile(r"(\[*)(?:([BCDFIJSZV])|L([^;]*);)")


class Truncated(ValueError):
    pass


class Cursor:
    """Big-endian reads. Counts past the end read as zero, while bytes and skips past it are an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def u1(self) -> int:
        return self.take(1)[0]

    def u2(self) -> int:
        at = self.at
        if at + 2 > len(self.data):
            return 0
        self.at = at + 2
        return self.data[at] << 8 | self.data[at + 1]

    def u4(self) -> int:
        return self.number(4)

    def number(self, n: int) -> int:
        if self.at + n > len(self.data):
            return 0
        self.at += n
        return int.from_bytes(self.data[self.at - n : self.at], "big")

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Truncated(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]


def text_of(data: bytes) -> str:
    return data.decode("ascii") if data.isascii() else data.decode("utf-8", "replace")


def type_names(descriptor: str) -> tuple[list[str], str]:
    """Simple names of the parameters and of the result of a method descriptor; what is none stays as it is."""

    def name(m: re.Match) -> str:
        return (PRIMITIVES[m[2]] if m[2] else m[3].rsplit("/", 1)[-1]) + "[]" * len(m[1])

    if not descriptor.startswith("(") or ")" not in descriptor:
        return [], descriptor
    inside, _, result = descriptor[1:].partition(")")
    found = _TYPE.fullmatch(result)
    return [name(m) for m in _TYPE.finditer(inside)], name(found) if found else result


class Pool:
    def __init__(self, cursor: Cursor):
        self.items: dict[int, tuple[int, bytes]] = {}
        self.texts: dict[int, str] = {}
        count, k, items, take = cursor.u2(), 1, self.items, cursor.take
        while k < count:
            tag = take(1)[0]
            if tag == 1:
                items[k] = tag, take(cursor.u2())
            elif tag in PAYLOAD:
                items[k] = tag, take(PAYLOAD[tag])
            else:
                raise ValueError(f"constant tag {tag}")
            k += 2 if tag in (5, 6) else 1

    def utf8(self, k: int) -> str:
        if k not in self.texts:
            tag, data = self.items.get(k, (0, b""))
            self.texts[k] = text_of(data) if tag == 1 else ""
        return self.texts[k]

    def class_name(self, k: int) -> str:
        tag, data = self.items.get(k, (0, b""))
        return self.utf8(int.from_bytes(data, "big")) if tag == 7 else ""


def value_of(c: Cursor, pool: Pool) -> tuple:
    """(tag, value): nested values for arrays, a string otherwise."""
    tag = chr(c.u1())
    if tag == "[":
        return tag, [value_of(c, pool) for _ in range(c.u2())]
    if tag == "@":
        return tag, annotation_of(c, pool)
    if tag == "e":
        c.u2()
        return tag, pool.utf8(c.u2())
    if tag in "BCDFIJSZsc":
        return tag, pool.utf8(c.u2())
    return tag, ""


def as_string(v: tuple) -> str:
    tag, value = v
    return value if tag == "s" else as_string(value[0]) if tag == "[" and value else ""


def element_row(name: str, v: tuple) -> dict:
    """The three readings of a value that the extractors use, so that no recursive type becomes a column."""
    tag, value = v
    strings = [value] if tag == "s" else [x for t, x in value if t == "s" and x] if tag == "[" else []
    enums = [value] if tag == "e" else [x for t, x in value if t == "e"] if tag == "[" else []
    return {"name": name, "tag": tag, "as_string": as_string(v), "as_strings": strings, "as_enums": enums}


def annotation_of(c: Cursor, pool: Pool) -> dict:
    kind = pool.utf8(c.u2())
    return {"type": kind, "elements": [element_row(pool.utf8(c.u2()), value_of(c, pool)) for _ in range(c.u2())]}


def attributes(c: Cursor, pool: Pool) -> list[tuple[str, bytes]]:
    return [(pool.utf8(c.u2()), c.take(c.u4())) for _ in range(c.u2())]


def annotations(found: list[tuple[str, bytes]], pool: Pool) -> list[dict]:
    """Those of the first well-formed visible attribute, else of the first well-formed invisible one."""
    for wanted in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
        for name, data in found:
            if name == wanted:
                c = Cursor(data)
                try:
                    return [annotation_of(c, pool) for _ in range(c.u2())]
                except ValueError:
                    continue
    return []


def members(c: Cursor, pool: Pool) -> list[dict]:
    out = []
    for _ in range(c.u2()):
        c.u2()
        name, descriptor = pool.utf8(c.u2()), pool.utf8(c.u2())
        own = attributes(c, pool)
        params, result = type_names(descriptor)
        out.append({"name": name, "descriptor": descriptor, "return_type": result, "param_types": params, "annotations": annotations(own, pool)})
    return out


def passed(c: Cursor) -> None:
    """Goes over fields or methods without reading them."""
    for _ in range(c.u2()):
        c.u2(), c.u2(), c.u2()
        for _ in range(c.u2()):
            c.u2()
            c.take(c.u4())


def decode(data: bytes, light: bool = False) -> dict:
    """The row of a class file; ValueError where it is none. A ``light`` row has no methods and no values of annotations."""
    c = Cursor(data)
    if c.u4() != 0xCAFEBABE:
        raise ValueError("no class file")
    minor, major = c.u2(), c.u2()
    pool = Pool(c)
    access, this, parent = c.u2(), pool.class_name(c.u2()), pool.class_name(c.u2())
    interfaces = [pool.class_name(c.u2()) for _ in range(c.u2())]
    passed(c)
    methods: list[dict] = []
    if light:
        passed(c)
    else:
        methods = members(c, pool)
    marks = annotations(attributes(c, pool), pool)
    if light:
        marks = [{"type": a["type"], "elements": []} for a in marks]
    return {
        "major": major, "minor": minor, "access": access, "this_class": this, "super_class": parent, "interfaces": interfaces,
        "class_annotations": marks, "methods": methods,
    }


# fixtures ------------------------------------------------------------------------------------


def encode(this: str, parent: str = "java/lang/Object", annotations: list | None = None, methods: list | None = None, major: int = 52, invisible: bool = False, interfaces: list[str] | None = None) -> bytes:
    """A class file. Annotations are (descriptor, {name: value}); a value is a string, a list, or ("e", type, name).
    Methods are (name, descriptor, annotations)."""
    pool: list[bytes] = []
    known: dict[bytes, int] = {}

    def constant(entry: bytes) -> int:
        if entry not in known:
            pool.append(entry)
            known[entry] = len(pool)
        return known[entry]

    def utf8(s: str) -> int:
        data = s.encode("utf-8")
        return constant(struct.pack(">BH", 1, len(data)) + data)

    def class_ref(s: str) -> int:
        return constant(struct.pack(">BH", 7, utf8(s)))

    def value(v) -> bytes:
        if isinstance(v, list):
            return struct.pack(">BH", ord("["), len(v)) + b"".join(map(value, v))
        if isinstance(v, tuple):
            return struct.pack(">BHH", ord("e"), utf8(v[1]), utf8(v[2]))
        return struct.pack(">BH", ord("s"), utf8(v))

    def attribute(found: list) -> bytes:
        if not found:
            return struct.pack(">H", 0)
        body = struct.pack(">H", len(found))
        for kind, elements in found:
            body += struct.pack(">HH", utf8(kind), len(elements)) + b"".join(struct.pack(">H", utf8(k)) + value(v) for k, v in elements.items())
        name = "RuntimeInvisibleAnnotations" if invisible else "RuntimeVisibleAnnotations"
        return struct.pack(">HHI", 1, utf8(name), len(body)) + body

    head = struct.pack(">HHH", 0x21, class_ref(this), class_ref(parent)) + struct.pack(">H", len(interfaces or [])) + b"".join(struct.pack(">H", class_ref(i)) for i in interfaces or [])
    body = struct.pack(">HH", 0, len(methods or []))
    for name, descriptor, found in methods or []:
        body += struct.pack(">HHH", 1, utf8(name), utf8(descriptor)) + attribute(found)
    body += attribute(annotations or [])
    return struct.pack(">IHHH", 0xCAFEBABE, 0, major, len(pool) + 1) + b"".join(pool) + head + body

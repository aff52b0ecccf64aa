"""Schemas of the relations, as DDL."""

ANNOTATION = "struct<type:string,elements:array<struct<name:string,tag:string,as_string:string,as_strings:array<string>,as_enums:array<string>>>>"
METHOD = f"struct<name:string,descriptor:string,return_type:string,param_types:array<string>,annotations:array<{ANNOTATION}>>"
CLASS_FIELDS = f"major int, minor int, access int, this_class string, super_class string, interfaces array<string>, class_annotations array<{ANNOTATION}>, methods array<{METHOD}>"
CLASS = "struct<" + CLASS_FIELDS.replace(", ", ",").replace(" int", ":int").replace(" string", ":string").replace(" array", ":array") + ">"
ENTRIES = f"input_id long, archive_name string, depth int, visit_seq long, close_seq long, entry_name string, kind string, data binary, parsed {CLASS}, error string, superseded boolean"
ROUTES = "url string, http_methods array<string>, class_name string, method_name string, framework string, source_type string, source_file string, archive_name string"

"""Canonical tables of the code graph."""

from __future__ import annotations

SCHEMA_VERSION = 1

SYMBOLS = "sym_id long, file string, name string, parent string, namespace string, tier int, kind string, signature string, start_line int, end_line int"
EDGES = "edge_id long, src_id long, dst_id long, dst_name string, dst_qualifier string, dst_ns string, kind string, confidence string, line int, src_file string"
FILES = "path string, hash string, size long, mtime long, lang string"
RAW_CALLS = "file string, enclosing_idx int, callee string, qualifier string, ns_hint string, line int"
RAW_DEPS = "file string, enclosing_idx int, kind string, target string, source string, line int"
DEPFILES = "path string, namespace string, version string, maphash string, curhash string, size long, mtime long, modified boolean"
OBS_EDGES = "src_key string, dst_key string, indirect boolean, weight long"
OBS_HEAT = "key string, leaf long, total long, entry long"
LEDGER = "path string, hash string, lang string, start long, end long, commit_id string, frames_total int, frames_resolved int, ingested_at long"
MEMBERS = "id string, root string, ord int, namespaces array<string>, deps array<string>"
SYMKEY = "struct<member:string,file:string,qname:string>"

SYMBOL_KINDS = ("func", "method", "type")
EDGE_KINDS = ("calls", "imports", "extends", "implements")
CONFIDENCES = ("unambiguous", "ambiguous", "unresolved")

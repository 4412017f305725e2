"""Pure helpers on names and paths, for literals and for tests of the column versions."""

from __future__ import annotations

import posixpath
import re

# Suffixes of a stem, tried in this order.
SUFFIXES = ("ing", "ers", "er", "ed", "es", "s")

# Groups of words that stand for each other in queries.
SYNONYMS = (
    ("get", "fetch", "load", "retrieve", "read", "lookup"),
    ("set", "put", "write", "store", "save", "persist"),
    ("init", "setup", "create", "new", "make", "build", "construct"),
    ("delete", "remove", "destroy", "drop", "clear", "purge"),
    ("config", "configuration", "settings", "options", "conf", "opts"),
    ("check", "validate", "verify", "assert", "ensure", "test"),
    ("send", "emit", "publish", "dispatch", "post", "broadcast"),
    ("receive", "consume", "subscribe", "listen", "poll"),
    ("find", "search", "locate", "query", "match"),
    ("handle", "process", "on", "callback", "hook"),
    ("start", "run", "launch", "exec", "execute", "invoke", "begin"),
    ("stop", "halt", "shutdown", "close", "end", "terminate", "kill"),
    ("update", "modify", "change", "edit", "patch", "mutate"),
    ("parse", "decode", "unmarshal", "deserialize", "scan"),
    ("format", "encode", "marshal", "serialize", "render", "print"),
    ("add", "append", "insert", "push", "register", "attach"),
    ("list", "all", "each", "iterate", "enumerate", "collect"),
    ("count", "len", "length", "size", "num", "total"),
    ("copy", "clone", "dup", "duplicate"),
    ("merge", "join", "combine", "concat", "union"),
    ("split", "divide", "partition", "chunk"),
    ("error", "err", "fail", "failure", "fault"),
    ("log", "debug", "trace", "print"),
    ("auth", "authenticate", "login", "signin", "authorize"),
    ("user", "account", "member", "principal"),
    ("request", "req", "call"),
    ("response", "resp", "reply", "result"),
    ("connect", "dial", "open", "attach"),
    ("cache", "memo", "memoize", "buffer"),
    ("wait", "block", "sleep", "pause", "delay"),
    ("retry", "backoff", "reattempt"),
    ("encrypt", "cipher", "seal"),
    ("decrypt", "unseal", "decode"),
    ("compress", "zip", "pack", "deflate"),
    ("path", "file", "filename", "filepath", "dir", "directory", "folder"),
    ("convert", "transform", "translate", "map", "cast", "to"),
    ("filter", "select", "where", "exclude"),
    ("sort", "order", "rank", "arrange"),
    ("compare", "diff", "equal", "cmp", "match"),
    ("watch", "observe", "monitor", "track"),
    ("apply", "commit", "flush", "sync"),
    ("clone", "fork", "spawn", "copy"),
    ("render", "draw", "paint", "display", "show"),
    ("hide", "conceal", "mask", "redact"),
    ("resolve", "lookup", "bind"),
    ("schedule", "queue", "enqueue", "defer"),
    ("lock", "mutex", "acquire", "hold"),
    ("unlock", "release", "free"),
    ("env", "environment", "context", "ctx"),
    ("max", "maximum", "limit", "cap", "bound"),
    ("min", "minimum", "floor"),
)

# Words that say nothing about a query.
STOPWORDS = (
    "the", "a", "an", "of", "for", "and", "or", "to", "in", "on", "at", "by", "with", "from", "as", "is", "are", "was", "be", "been",
    "this", "that", "these", "those", "it", "its", "if", "not", "no", "all", "any", "can", "cant", "will", "should", "may", "when",
    "which", "who", "what", "how", "into", "out", "up", "down", "over", "under", "than", "then", "them", "they", "there", "here", "also",
    "such", "some", "same", "other", "using", "used", "use", "does", "doesnt", "why", "after", "before", "while",
)

# Words that do not tell one concept from another.
CONCEPT_STOPWORDS = (
    "the", "a", "an", "of", "for", "and", "or", "to", "in", "on", "at", "by", "with", "from", "as", "is", "are", "was", "be", "been",
    "this", "that", "these", "those", "it", "its", "if", "not", "no", "all", "any", "can", "will", "should", "may", "when", "which", "who",
    "what", "how", "into", "out", "up", "down", "over", "under", "than", "then", "them", "they", "there", "here", "also", "such", "some",
    "same", "other", "given", "returns", "return", "gets", "sets", "value", "values", "instance", "new", "specified", "using", "used",
    "use",
)

#: Where an identifier breaks: between a lower letter or digit and what starts anew, inside an acronym before its last capital, around digits.
BREAKS = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9])|(?<=[A-Z])(?=[A-Z][a-z])")
SEPARATORS = r"[_\-.$ ]+"


def split_anchor(anchor: str) -> tuple[str, str]:
    """(name, parent) of `parent::name` or `parent.name`; the parent is empty if neither mark stands after a first character."""
    if (at := anchor.find("::")) > 0:
        return anchor[at + 2 :], anchor[:at]
    if (at := anchor.rfind(".")) > 0:
        return anchor[at + 1 :], anchor[:at]
    return anchor, ""


def tokenize(identifier: str) -> list[str]:
    return [t.lower() for part in re.split(SEPARATORS, identifier) for t in BREAKS.split(part) if t]


def stem(token: str) -> str:
    return next((token[: -len(s)] for s in SUFFIXES if token.endswith(s) and len(token) - len(s) >= 3), token)


def expand(token: str) -> list[str]:
    """What a query token (a stem) also stands for."""
    return sorted({w for group in SYNONYMS if token in group for w in group} - {token})


def glob_to_regex(pattern: str) -> str:
    """A glob over slash-separated paths as a regular expression of the whole path: `*` and `?` stay within a segment, `**` does not, and `**/` may be nothing."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(t) or re.escape(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)) + "$"


def normalize_hint(language: str, file: str, source: str, target: str) -> str:
    """The namespace an import binds: relative specifiers become clean paths, and a PHP name loses its last segment if that is what is imported."""
    if source.startswith(("./", "../")):
        return posixpath.normpath(posixpath.join(posixpath.dirname(file), source))
    if language == "php" and source.rpartition("\\")[2] == target:
        return source.rpartition("\\")[0]
    return source


def distinctive_words(query: str, most: int) -> list[str]:
    """The longest words of three letters or more that are no stopwords, of one length in the order of the query."""
    words = dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_]*", query))
    return sorted((w for w in words if len(w) >= 3 and w not in STOPWORDS), key=len, reverse=True)[:most]


def quoted_phrase(query: str) -> str:
    found = re.search(r"\"([^\"]+)\"|'([^']+)'|`([^`]+)`", query)
    return next((g for g in found.groups() if g), "") if found else ""


def quoted(literal: str) -> str:
    """A literal as a pattern, whatever it holds."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", literal)

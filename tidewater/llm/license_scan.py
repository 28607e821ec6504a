"""Licence scans: Aho-Corasick over word-normalised text, and a shunting-yard reader of licence expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import documents_of, raw, slices

#: Notice phrases and their labels. The first three are the base set.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICE_PHRASES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "all rights reserved": "reserved",
    "public domain": "public-domain",
}
#: Tags before a licence expression (as words), and licence families by identifier prefix.
TAGS = ("spdx license identifier", "license expression")
FAMILIES = {"mit": "mit", "apache-": "apache", "gpl-": "gpl", "lgpl-": "lgpl", "agpl-": "agpl", "mpl-": "mpl", "epl-": "epl", "bsd-": "bsd", "isc": "isc", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "cc0-": "public-domain", "unlicense": "public-domain", "bsl-": "bsl", "0bsd": "bsd", "zlib": "zlib", "x11": "x11", "ncsa": "ncsa", "postgresql": "postgresql", "artistic-": "artistic", "python-": "python", "psf-": "python", "wtfpl": "wtfpl", "cddl-": "cddl", "eupl-": "eupl", "ofl-": "ofl", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "licenseref-": "custom"}
#: Beginnings of exceptions that let a work under other terms be combined with the licensed one.
LOOSENING = ("classpath-exception", "gcc-exception", "llvm-exception", "bison-exception", "autoconf-exception", "libtool-exception", "font-exception", "openjdk-assembly-exception", "u-boot-exception", "swift-exception", "wxwindows-exception")
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "cc-by", "public-domain", "bsl", "zlib", "x11", "ncsa", "postgresql", "python", "wtfpl"})

#: Word bytes are digits, letters (upper case folded to lower) and all bytes over 0x7F; the others part words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_EXPRESSION = re.compile(r"(?:spdx-license-identifier|license-expression)\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()/,]|[a-z0-9][a-z0-9.+-]*")
_BINDING = {"or": 1, "/": 1, ",": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    """The family of a licence identifier, null for a word that is none."""
    name = identifier.rstrip(".+")
    fits = [p for p in FAMILIES if name == p or name.startswith(p if p.endswith("-") else p + "-")]
    return FAMILIES[max(fits, key=len)] if fits else None


def read_expression(text: str) -> tuple[list[str], bool] | None:
    """Shunting-yard: (licence families in order, whether permissive terms can be chosen); None if malformed.

    `or` lets the reader choose, and so do a slash and a comma between identifiers; `and` binds to both sides; `with`
    adds an exception to the licence on its left, and one of LOOSENING frees it. Only known identifiers, and those
    that begin with LicenseRef-, are operands: an expression ends where the text stops to be one, and an operator
    before a word that is no operand ("GPL-2.0 or later") belongs to what is left over.
    """
    output: list[tuple[str, bool]] = []
    pending: list[str] = []
    found: list[str] = []

    def apply(op: str) -> bool:
        if len(output) < 2:
            return False
        (right, free_r), (left, free_l) = output.pop(), output.pop()
        free = free_l and free_r if op == "and" else free_l or free_r
        output.append((left, free))
        return True

    wants_operand = True
    after_with = False
    for token in _TOKEN.findall(text.lower()):
        if token in _BINDING:
            if wants_operand:
                if pending and pending[-1] in ("/", ",", "or", "and"):
                    break
                return None
            while pending and pending[-1] != "(" and _BINDING[pending[-1]] >= _BINDING[token]:
                if not apply(pending.pop()):
                    return None
            pending.append(token)
            wants_operand, after_with = True, token == "with"
        elif token == "(":
            if not wants_operand or after_with:
                break
            pending.append(token)
        elif token == ")":
            if wants_operand:
                return None
            while pending and pending[-1] != "(":
                if not apply(pending.pop()):
                    return None
            if not pending:
                break
            pending.pop()
        else:
            name = token if after_with and ("exception" in token or token.endswith("-note")) else None if after_with else family(token)
            if not wants_operand or name is None:
                break
            if not after_with:
                found.append(name)
            output.append((name, name.startswith(LOOSENING) if after_with else name in PERMISSIVE))
            wants_operand = after_with = False
    if wants_operand and found and pending and pending[-1] != "(":
        pending.pop()  # an operator before what is no operand
        wants_operand = False
    if wants_operand:
        return None
    while pending:
        if (op := pending.pop()) == "(" or not apply(op):
            return None
    return (found, output[0][1]) if len(output) == 1 else None


def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    kinds = [*((p, ("base", label)) for p, label in BASE_PHRASES.items()), *((p, ("notice", label)) for p, label in NOTICE_PHRASES.items()), *((p, ("tag", p)) for p in TAGS)]
    for phrase, kind in kinds:
        machine.add_word(f" {phrase} ", (len(phrase) + 1, *kind))
    machine.make_automaton()
    return machine


def scan_text(text: bytes | None, machine) -> tuple:
    words = b" ".join((text or b"").translate(FOLD).split())
    n_words = words.count(b" ") + 1 if words else 0
    base: list[tuple[int, str]] = []
    notices: set[str] = set()
    tags = 0
    if n_words:
        for end, (length, kind, label) in machine.iter(f" {words.decode('latin-1')} "):
            if kind == "base":
                base.append((end - length, label))
            elif kind == "notice":
                notices.add(label)
            else:
                tags += 1
    expressions = []
    if tags:
        for m in _EXPRESSION.finditer(text.decode("utf-8", "replace")):
            if (got := read_expression(m[1])) is not None:
                expressions.append((m[1].strip(), *got))
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32) if base else np.empty(0, np.int64)
    starts = np.searchsorted(gaps, [max(0, at) for at, _ in base]).tolist()
    base_labels = sorted({label for _, label in base})
    named = sorted({label for _, found, _ in expressions for label in found})
    score = 1.0
    for weight, n in ((0.5, len(base_labels)), (0.3, len(notices)), (0.8, len(expressions))):
        score *= (1.0 - weight) ** min(n, 20)
    return (n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(sorted({*base_labels, *notices, *named})), 1.0 - score, [e[0] for e in expressions], all(e[2] for e in expressions) if expressions else None)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: places of licence phrases and what licence expressions say.

    Null or empty text: 0 words, no labels, score 0. Null ids and repeated rows stay, each with its own row. Very long
    texts are scanned whole. Ties don't arise: all places count, and labels are sorted. Extra columns play no part, whatever
    their names. An empty table gives an empty result. A malformed expression is passed over. One narrow pass, no shuffle.
    """

    def run(batches):
        machine = _automaton()
        for batch in slices(batches):
            rows = [scan_text(t, machine) for t in raw(batch.column(1))]
            columns = list(zip(*rows)) if rows else [[] for _ in range(9)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:]))], schema=_ARROW)

    return documents_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)

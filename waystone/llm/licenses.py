"""Licence scan: Aho-Corasick over words, and licence expressions by a shunting-yard parser.

One automaton holds all notice phrases and the identifier tag. Texts are lower-cased (A-Z) and their words joined by
single spaces, so a phrase matches where its words stand consecutively, whatever stands between them. Where the tag is
found, the expression behind it, to the end of its line, is parsed from the raw text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

from .textarrays import LOWER_BYTES, NOT_ALNUM

#: Phrases whose places are counted.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrases that only add labels.
MORE = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "cc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "public domain": "public-domain",
    "cc0": "public-domain",
}
#: Labels that allow free reuse.
FREE = {"mit", "apache", "bsd", "mpl", "cc-by", "cc-by-sa", "public-domain", "cc"}
TAG = "spdx license identifier"
#: What stands between an identifier tag's words and its expression, which ends with the line.
_AFTER_TAG = re.compile(rb"[ \t]*:[ \t]*([^\r\n]*)")
_RUN = re.compile(rb"[^ ]+")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_PRIORITY = {"or": 1, "and": 2, "with": 3}
_WORDS = bytes(32 if NOT_ALNUM[LOWER_BYTES[i]] else LOWER_BYTES[i] for i in range(256))


def label_of(identifier: str) -> str:
    """The family of a licence identifier: its name without version; cc-by variants and lower-case names stay apart."""
    name = identifier.lower().rstrip("+")
    if name.startswith(("cc0", "unlicense")):
        return "public-domain"
    name = re.sub(r"-(only|or-later)$", "", name)
    return re.sub(r"-v?[0-9][0-9.]*(-clause)?$", "", name)


def parse(expression: str) -> list[str] | None:
    """Shunting-yard: the expression in postfix order; None if it is malformed. `with` binds tightest, `or` least.

    Text after the first complete expression ends it, as comment closers and prose follow tags.
    """
    out: list[str] = []
    stack: list[str] = []
    operand, depth = False, 0
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if operand:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif low in _PRIORITY:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _PRIORITY[stack[-1]] >= _PRIORITY[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        else:
            if operand:
                break
            out.append(token)
            operand = True
    if not operand or depth:
        return None
    while stack:
        out.append(stack.pop())
    return out


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """All labels of an expression and how free its use is: or takes the better side, and the worse; with keeps the left."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _PRIORITY:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, x) if token == "with" else (a | b, max(x, y) if token == "or" else min(x, y)))
        else:
            label = label_of(token)
            stack.append(({label}, 1.0 if label in FREE else 0.0))
    return stack[0]


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {**BASE, **MORE, TAG: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str, found) -> tuple[int, list[dict], str, str, float]:
    """Words, places of base phrases, base labels, all labels and score of one text."""
    raw = text.encode()
    flat = raw.translate(_WORDS)
    words = flat.split()
    joined = " " + b" ".join(words).decode() + " "
    places, base, more, tags = [], set(), set(), []
    at, word = 0, 0
    hits = sorted((end - len(p) - 1, p) for end, p in found.iter(joined))
    for start, phrase in hits:
        word += joined.count(" ", at + 1, start + 1)
        at = start
        if phrase in BASE:
            places.append({"phrase": phrase, "word": word})
            base.add(BASE[phrase])
        elif phrase == TAG:
            tags.append(word + TAG.count(" "))
        else:
            more.add(MORE[phrase])
    free = [1.0 if x in FREE else 0.0 for x in base | more]
    if tags:
        # translation keeps every byte's place, so a tag's last word tells where its expression begins
        ends = [m.end() for m in _RUN.finditer(flat)]
        for last in tags:
            m = _AFTER_TAG.match(raw, ends[last])
            postfix = parse(m[1].decode(errors="replace")) if m else None
            if postfix:
                labels, use = evaluate(postfix)
                more |= labels
                free.append(use)
    return len(words), places, ",".join(sorted(base)), ",".join(sorted(base | more)), min(free) if free else 0.5


RESULT = "n_words bigint, places array<struct<phrase:string,word:bigint>>, base_labels string, labels string, score double"


def _scanned(names: list[str]):
    kind = pa.list_(pa.struct([("phrase", pa.string()), ("word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                n, places, base, labels, score = zip(*(scan(t or "", found) for t in part.column("_text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n, pa.int64()), pa.array(places, kind), pa.array(base), pa.array(labels), pa.array(score, pa.float64())], [*names, "n_words", "places", "base_labels", "labels", "score"])

    return run


@B.keeps_columns("n_words", "places", "base_labels", "labels", "score")
def scan_licenses(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Docs with `n_words`, `places` of the base phrases, `base_labels`, `labels` and `score` (1: free reuse, 0: not,
    0.5: nothing found; the strictest of what is found).

    Null and empty texts have no words and no labels (empty strings). Columns of docs with these names give way.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), RESULT])
    return docs.withColumn("_text", F.col(text)).mapInArrow(_scanned(docs.columns), schema)

"""Licence scan: identifier tags and notice phrases by Aho-Corasick, expressions by a shunting yard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import without

#: Phrases that give the base labels, as words.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4": "cc-by",
    "cc0 1": "cc0",
    "dedicated to the public domain": "public-domain",
}
TAG = "spdx license identifier"
#: How far a licence lets a text be used again; one not listed here counts as UNKNOWN.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9,
    "mpl": 0.7, "lgpl": 0.7, "cc-by-sa": 0.6, "gpl-2": 0.5, "gpl-3": 0.5, "agpl": 0.4, "cc-by-nc": 0.2, "cc-by-nd": 0.2,
    "all-rights-reserved": 0.0,
}
UNKNOWN, WITH_EXCEPTION = 0.3, 0.7
BINDS = {"with": 3, "and": 2, "or": 1}
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]

_WORD_BYTES = bytes(b for b in range(256) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b in _WORD_BYTES else 32 for b in range(256))
_EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_PART = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+:-]+)")


def label_of(identifier: str) -> str:
    """The label of an identifier: lower case, without a minor version and without -only or -or-later."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"\.0$", "", name)
    return re.sub(r"^(cc-by(?:-[a-z]+)*|cc0|mpl|lgpl|agpl|isc)-[0-9.]+$", r"\1", name)


def _apply(stack: list, operator: str) -> None:
    right, left = stack.pop(), stack.pop()
    if operator == "with":
        stack.append((max(left[0], WITH_EXCEPTION), left[1]))
    elif operator == "and":
        stack.append((min(left[0], right[0]), left[1] | right[1]))
    else:
        stack.append(max(left, right, key=lambda x: x[0]))


def _parts(expression: str) -> Iterator[str]:
    """Brackets, operators and identifiers up to the first character that is in none of them."""
    at = 0
    while found := _PART.match(expression, at):
        yield found[1]
        at = found.end()


def evaluate(expression: str, freedom: dict[str, float] = FREEDOM) -> tuple[float, frozenset] | None:
    """Freedom and labels of a licence expression; of ``or`` the freer side holds, the left one of equals.

    ``with`` binds before ``and``, ``and`` before ``or``. The expression ends at a character that belongs to none,
    and where no operand or operator can follow, as at the end of a comment; null if it is not well-formed.
    """
    values: list = []
    operators: list[str] = []
    operand_next = True
    for part in _parts(expression):
        word = part.lower()
        if part == "(" and operand_next:
            operators.append(part)
        elif part == ")" and not operand_next:
            while operators and operators[-1] != "(":
                _apply(values, operators.pop())
            if not operators:
                break
            operators.pop()
        elif word in BINDS and not operand_next:
            while operators and operators[-1] != "(" and BINDS[operators[-1]] >= BINDS[word]:
                _apply(values, operators.pop())
            operators.append(word)
            operand_next = True
        elif operand_next and part not in "()" and word not in BINDS:
            label = label_of(part)
            values.append((freedom.get(label, UNKNOWN), frozenset([label])))
            operand_next = False
        else:
            break
    if operand_next or "(" in operators:
        return None
    while operators:
        _apply(values, operators.pop())
    return values[0] if values else None


@lru_cache(maxsize=8)
def automaton(phrases: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    """Finds the base phrases, these further ones and the tag, as whole words."""
    found = ahocorasick.Automaton()
    for phrase, label in (dict(phrases) | BASE | {TAG: ""}).items():
        found.add_word(f" {phrase} ".encode().decode("latin-1"), (label, len(phrase.encode()) + 1, phrase in BASE))
    found.make_automaton()
    return found


def scan(text: str | None, notices: dict[str, str] = NOTICES, freedom: dict[str, float] = FREEDOM) -> tuple:
    """The values of ``COLUMNS`` for one text."""
    text = text or ""
    words = text.encode("utf-8", "replace").translate(_TO_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    base, labels, score, tagged = set(), set(), [], False
    n_base, first, last = 0, len(line), -1
    for end, (label, back, is_base) in automaton(tuple(notices.items())).iter(line.decode("latin-1")):
        if not label:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            base.add(label)
            n_base, first, last = n_base + 1, min(first, end - back), max(last, end - back)
    score = [freedom.get(label, UNKNOWN) for label in labels]
    if tagged:
        for value in filter(None, (evaluate(x, freedom) for x in _EXPRESSION.findall(text))):
            score.append(value[0])
            labels |= value[1]
    places = [line.count(b" ", 0, at) if n_base else None for at in (first, last)]
    return len(words), n_base, *places, ",".join(sorted(base)), ",".join(sorted(labels)), min(score, default=0.0)


def scan_licences(df: DataFrame, text: str = "text", notices: dict[str, str] = NOTICES, freedom: dict[str, float] = FREEDOM) -> DataFrame:
    """Adds ``COLUMNS`` to the columns of ``df`` less its text; columns of these names are replaced.

    Words are runs of digits, letters (A-Z lower-cased) and all characters beyond ASCII. ``n_base``
    counts every place of a base phrase, overlapping ones included; the first and last place are null
    without one. ``labels`` also has those of ``notices`` (phrases in lower case, words parted by one space, with their
    labels) and of well-formed tag expressions.
    ``score`` is the freedom of the strictest of them by ``freedom``, 0 without any. Null is as empty: no words, no
    labels. One pass per text, no shuffle.
    """

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = pd.DataFrame([scan(t, notices, freedom) for t in texts], columns=COLUMNS)
            yield found.astype({"first_word": "Int64", "last_word": "Int64"})

    rest = without(df, *COLUMNS, text).columns
    scan_texts = F.pandas_udf(scanned, SCHEMA)
    found = df.select(*[F.col(f"`{c}`") for c in rest], scan_texts(F.col(f"`{text}`")).alias("__found"))
    return found.select(*[F.col(f"`{c}`") for c in rest], "__found.*")

"""Line-first quality rules.

Each line is judged on its own by three rules, failing lines are taken out, and a document that loses
too many of its words to them is rejected, as is one that fails the base counts of the whole text.

* punctuation: no word of the line ends in a mark of ``.,!?:;"')]``, or over a tenth of its bytes in words
  are symbols of ``[#*$%&|<>]``, or over a third of its words end in two exclamation marks;
* navigation: it holds at least two separators (``|``, ``>>``, ``::``) as words of their own and they are
  at least a quarter of its words;
* boilerplate: stock phrases of web pages (in four languages) make up at least a fifth of its words, or over
  half of its words equal the word before. A phrase in a long line of prose fails nothing.

Defined cases: a null or empty text has no words, fails the base rule and is rejected. Lines without a
word are neither judged nor counted. Rows are judged one by one, so repeated rows, ties, null ids and
other columns change nothing; an empty table gives an empty result. Whole texts are read; memory is
that of one Arrow batch and one document.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map

#: The symbols, closing marks, separators and stock phrases of the rules.
SYMBOLS = "#*$%&|<>"
CLOSING = ".,!?:;\"')]"
SEPARATORS = ("|", ">>", "::")
PHRASES = (
    "all rights reserved",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "click here",
    "sign up for our newsletter",
    "subscribe to our",
    "enable javascript",
    "lorem ipsum",
    "skip to content",
    "share this page",
    "powered by",
    "alle rechte vorbehalten",
    "hier klicken",
    "zum newsletter anmelden",
    "verwendet cookies",
    "tous droits réservés",
    "cliquez ici",
    "abonnez-vous à notre",
    "utilise des cookies",
    "todos los derechos reservados",
    "haga clic aquí",
    "suscríbase a nuestro",
    "utiliza cookies",
)
#: Words of a line for each word of stock phrases in it, from which on it passes.
PHRASE_SHARE = 5

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A document that loses over this share of its words with failing lines is rejected.
MAX_LOST_PERCENT = 30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_lines long, n_bad_punctuation long, n_navigation long,"
    " n_boilerplate long, n_lost_words long"
)

_BOILERPLATE = re.compile("|".join(re.escape(p) for p in PHRASES).encode())
_PHRASES = [(p.encode(), len(p.split())) for p in PHRASES]
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]".encode())
_SHOUT = re.compile(rb"!!(?![^\x20\x09-\x0D])")
_CLOSED = re.compile(rf"[{re.escape(CLOSING)}](?![^\x20\x09-\x0D])".encode())
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)


def line_faults(line: bytes, words: list[bytes]) -> tuple[bool, bool, bool]:
    """(punctuation, navigation, boilerplate) of a line with at least one word; true: it fails that rule."""
    n = len(words)
    punctuation = (
        not _CLOSED.search(line)
        or 10 * len(_SYMBOL.findall(line)) > sum(map(len, words))
        or 3 * len(_SHOUT.findall(line)) > n
    )
    apart = sum(w in _SEPARATORS for w in words) if b"|" in line or b">>" in line or b"::" in line else 0
    stutter = 2 * sum(map(eq, words, words[1:])) > n
    low = line.lower()
    stock = sum(low.count(p) * k for p, k in _PHRASES) if _BOILERPLATE.search(low) else 0
    return punctuation, apart >= 2 and 4 * apart >= n, stutter or (stock > 0 and PHRASE_SHARE * stock >= n)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for i in range(window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    # equal hashes are followed by a look at the words themselves
    for a, b in zip(order[:-1][same].tolist(), order[1:][same].tolist(), strict=True):
        if words[a : a + window] == words[b : b + window]:
            twice[a] = twice[b] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: str | None, max_lost_percent: int = MAX_LOST_PERCENT) -> tuple:
    """The figures of one document, in the order of SCHEMA after doc_id, then the flags of its lines."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen, n_lines, dup, lost = set(), 0, 0, 0
    faults = [0, 0, 0]
    keep: list[bool] = []
    for line in raw.split(b"\n"):
        its = line.split()
        if not its:
            keep.append(True)
            continue
        n_lines += 1
        dup += line in seen
        seen.add(line)
        found = line_faults(line, its)
        bad = any(found)
        keep.append(not bad)
        if bad:
            lost += len(its)
            faults = [a + b for a, b in zip(faults, found, strict=True)]
    repeat = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    kept = not base_failed and 100 * lost <= max_lost_percent * n
    return n, word_chars, n_symbols, dup, repeat, base_failed, kept, n_lines, *faults, lost, keep


def line_first_quality(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text)."""
    names = [field.split()[0] for field in SCHEMA.split(",")]

    def rows(batch: dict) -> dict:
        out = {c: [] for c in names}
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            for c, v in zip(names, (doc_id, *judge(text, max_lost_percent)), strict=False):
                out[c].append(v)
        return out

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, SCHEMA)


def clean_documents(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """docs without rejected documents; kept ones lose their failing lines. All columns of docs stay as they
    are, n_chars (where it is a column) is that of the new text. Line ends inside a text stay \\n."""
    import pyarrow as pa

    names = docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, kept = [], []
                for text in part.column(names.index("text")).to_pylist():
                    got = judge(text, max_lost_percent)
                    kept.append(got[6])
                    if got[6]:
                        texts.append("\n".join(x for x, ok in zip(text.split("\n"), got[-1], strict=True) if ok))
                left = part.filter(pa.array(kept, pa.bool_()))
                columns = list(left.columns)
                columns[names.index("text")] = pa.array(texts, left.schema.field("text").type)
                if "n_chars" in names:
                    columns[names.index("n_chars")] = pa.array([len(t) for t in texts], left.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(columns, schema=left.schema)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)

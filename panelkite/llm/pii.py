"""Personal data, and information-theoretic sanitisation of what stands around it.

Emails, IP addresses, card and phone numbers are found by fixed patterns.  Then
corpus co-occurrence tells how strongly a term reveals such an entity: with
p(k) the share of all words that stand near an entity of kind k, and p(k | t)
that share among a term's own occurrences, the term discloses
PMI(t; k) / IC(k) = log(p(k | t) / p(k)) / -log p(k), 1 if it never stands
elsewhere.  In all documents, terms above a first threshold for some kind are
generalised to their kind of word, above a second removed.  A term that stands
near entities of a kind fewer than 8 times is harmless: chance could do that.

Terms are counted one by one, by the 64-bit hash of the whole word: first near
entities, then, for terms seen there often enough, in all documents.  A bitmap
of fixed size, filled from those terms, only keeps most other words out of the
second count.  The terms above a threshold are sent to all tasks; each stands
near entities at least 8 times, so there are no more than entities.  Null texts
count as empty; texts of any length are read whole and in linear time; empty
tables give empty results; repeated rows are found alike; other columns pass
through (those of our names, "pii_...", are replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.llm import _base, _text

#: Fixed by the contract.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is taken or left as a whole, so that long ones aren't read again from each digit.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ADDED = ("generalise", "remove")
FILTER_BITS = 22
NEAR = 4
LEAST = 8
GENERALISE, REMOVE = 0.6, 0.9
#: Words that a task counts at a time.
_COUNTED = 1 << 20

#: Hashes of terms, ascending, and uint8 [kind, term]: 0 harmless, 1 to generalise, 2 to remove.
Terms = tuple[np.ndarray, np.ndarray]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match is at the first @ with a local part before it and a domain behind it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def term_hashes(words: list[str]) -> np.ndarray:
    """The hash of each word that whole texts are counted by, without the case of A-Z."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.concatenate([h for _, h, _ in _text.words([" ".join(words)])])


def around(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
    """Places of the words outside the spans, and for each kind which of them are near one."""
    places = [m.span() for m in WORD.finditer(text)]
    starts = np.array([s for s, _ in places])
    ends = np.array([e for _, e in places])
    free = np.ones(len(places), bool)
    reach: list[tuple[int, int, int]] = []
    for s, k, e in spans:
        first, last = int(np.searchsorted(ends, s, "right")), int(np.searchsorted(starts, e, "left"))
        free[first:last] = False
        reach.append((k, first, last))
    near: dict[int, set[int]] = {}
    for k, first, last in reach:
        near.setdefault(k, set()).update(i for i in (*range(max(0, first - NEAR), first), *range(last, min(len(places), last + NEAR))) if free[i])
    return [p if free[i] else (-1, -1) for i, p in enumerate(places)], {k: sorted(v) for k, v in near.items()}


def _counted(kind: int, hashes: list[np.ndarray]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(hashes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "h", "n"])


def near_counts(docs: DataFrame) -> DataFrame:
    """(k, h, n): how often each term stands near entities of each kind; docs has the text only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in _base.slices(batches, 512):
            found: dict[int, list[str]] = {}
            for value in batch.column(0).to_pylist():
                if value and (spans := base_spans(value)):
                    places, near = around(value, spans)
                    for k, own in near.items():
                        found.setdefault(k, []).extend(value[places[i][0] : places[i][1]] for i in own)
            for k, terms in found.items():
                held.setdefault(k, []).append(term_hashes(terms))
                if sum(map(len, held[k])) >= _COUNTED:
                    yield _counted(k, held.pop(k))
        for k, own in held.items():
            yield _counted(k, own)

    return docs.mapInArrow(run, "k int, h bigint, n bigint").groupBy("k", "h").agg(F.sum("n").alias("n"))


def all_counts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(k, h, n): with k = 0 how often each term that passes the bitmap stands anywhere, with k = 1 the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        held: list[np.ndarray] = []
        total = size = 0
        for batch in _base.slices(batches, 512):
            for _, h, _ in _text.words(batch.column(0).to_pylist()):
                total += len(h)
                held.append(h[may[h >> np.uint64(64 - FILTER_BITS)]])
                size += len(held[-1])
                if size >= _COUNTED:
                    yield _counted(0, held)
                    held, size = [], 0
        if held:
            yield _counted(0, held)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["k", "h", "n"])

    return docs.mapInArrow(run, "k int, h bigint, n bigint").groupBy("k", "h").agg(F.sum("n").alias("n"))


def disclosures(docs: DataFrame, text: str = "text") -> Terms:
    """The terms that aren't harmless, from all documents."""
    docs = docs.select(text)
    near = _base.stored(near_counts(docs), "near-terms")
    sums = {r["k"]: r["n"] for r in near.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    each = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"_near{k}") for k in range(len(KINDS))]
    often = _base.stored(near.groupBy("h").agg(*each).where(F.greatest(*[f"_near{k}" for k in range(len(KINDS))]) >= LEAST), "often-near")
    cell = often.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("c"))
    bits = cell.groupBy((F.shiftright("c", 6)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(c & 63 AS INT))")).alias("b")).toArrow()
    wanted = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    wanted[bits["w"].to_numpy()] = bits["b"].to_numpy()
    counts = _base.stored(all_counts(docs, wanted), "all-terms")
    words = max((counts.where("k = 1").agg(F.sum("n").alias("n")).first()["n"]) or 0, 1)
    level = []
    for k in range(len(KINDS)):
        share = sums.get(k, 0) / words
        if 0 < share < 1:
            own = F.least(F.col(f"_near{k}") / F.col("n"), F.lit(1.0))
            known = F.when(F.col(f"_near{k}") >= LEAST, F.log(own / share) / -float(np.log(share)))
            level.append(F.when(known >= REMOVE, 2).when(known >= GENERALISE, 1).otherwise(0).cast("tinyint").alias(f"_level{k}"))
        else:
            level.append(F.lit(0).cast("tinyint").alias(f"_level{k}"))
    rows = counts.where("k = 0").select(F.col("h").alias("_h"), "n").join(often, F.col("_h") == F.col("h")).select("h", *level)
    found = rows.where(F.greatest(*[f"_level{k}" for k in range(len(KINDS))]) > 0).toArrow()
    hashes = found["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.stack([found[f"_level{k}"].to_numpy().astype(np.uint8)[order] for k in range(len(KINDS))])


def disclosing(texts: list[str | None], terms: Terms) -> set[int]:
    """Places of the texts that hold a term that isn't harmless."""
    hashes, _ = terms
    out: set[int] = set()
    if len(hashes):
        for first, own, bounds in _text.words(texts):
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            out.update((first + np.searchsorted(bounds, np.flatnonzero(hashes[at] == own), "right") - 1).tolist())
    return out


def all_spans(text: str, terms: Terms, disclosed: bool = True) -> list[tuple[int, int, int]]:
    """Base spans and those that the method adds (kinds 4 and 5), by start, then kind; disclosed: whether there may be any to add."""
    base = base_spans(text)
    hashes, levels = terms
    if not disclosed or not len(hashes):
        return base
    places, _ = around(text, base)
    real = [(s, e) for s, e in places if s >= 0]
    own = term_hashes([text[s:e] for s, e in real])
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    level = np.where(hashes[at] == own, levels[:, at].max(axis=0), 0)
    return sorted([*base, *[(*real[i][:1], 3 + int(level[i]), real[i][1]) for i in np.flatnonzero(level)]])


def sanitised(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with entities replaced by their kind, terms generalised or removed."""
    out, at = [], 0
    for start, kind, end in spans:
        if start < at:
            continue
        out.append(text[at:start])
        if kind < len(KINDS):
            out.append(f"[{KINDS[kind].upper()}]")
        elif kind == len(KINDS):
            out.append("[NUMBER]" if any(c.isdigit() for c in text[start:end]) else "[NAME]" if text[start].isupper() else "[WORD]")
        at = end
    return "".join([*out, text[at:]])


def _named(spans: list[tuple[int, int, int]]) -> str:
    names = KINDS + ADDED
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def spans_of(docs: DataFrame, text: str = "text", clean: bool = True) -> DataFrame:
    """docs with pii_email, pii_ip, pii_card, pii_phone, pii_base, pii_spans, pii_found (how many spans) and, if asked for, pii_clean (the sanitised text)."""
    shared = docs.sparkSession.sparkContext.broadcast(disclosures(docs, text))
    docs = docs.drop(*[f"pii_{k}" for k in KINDS], "pii_base", "pii_spans", "pii_found", "pii_clean")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in _base.slices(batches):
            new: dict[str, list] = {f"pii_{k}": [] for k in KINDS} | {"pii_base": [], "pii_spans": [], "pii_found": []} | ({"pii_clean": []} if clean else {})
            texts = batch.column(place).to_pylist()
            disclosed = disclosing(texts, terms)
            for i, value in enumerate(texts):
                spans = all_spans(value or "", terms, i in disclosed)
                base = [s for s in spans if s[1] < len(KINDS)]
                for j, k in enumerate(KINDS):
                    new[f"pii_{k}"].append(sum(s[1] == j for s in base))
                new["pii_base"].append(_named(base))
                new["pii_spans"].append(_named(spans))
                new["pii_found"].append(len(spans))
                if clean:
                    new["pii_clean"].append(sanitised(value or "", spans))
            kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield _base.append_columns(batch, {n: pa.array(v, k) for (n, v), k in zip(new.items(), kinds)})

    extra = [*[(f"pii_{k}", "bigint") for k in KINDS], ("pii_base", "string"), ("pii_spans", "string"), ("pii_found", "bigint"), *([("pii_clean", "string")] if clean else [])]
    return docs.mapInArrow(run, _base.schema_with(docs, *extra))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spans_of(_base.table(spark, sf_dir, "documents").select("doc_id", "text"), clean=False)
    return done.select("doc_id", *[F.col(f"pii_{k}").alias(f"n_{k}") for k in KINDS], F.sha2(F.col("pii_base").cast("binary"), 256).alias("base_sha256"), F.col("pii_spans").alias("spans"), F.col("pii_found").alias("n_spans"))

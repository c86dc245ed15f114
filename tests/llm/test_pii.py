import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkite.llm import _text, pii


def luhn(d):
    return sum(n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@.@-+ 0123459()%é\n", max_size=40))
def test_base_spans_as_the_patterns_say(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 50_000, "@" * 100_000, "a@" * 100_000, "1 " * 100_000, "+1" + " " * 100_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)


def test_query_on_whole_table(spark, sf_dir, texts):
    rows = pii.op2_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    names = ("email", "ip", "card", "phone")
    for r in rows:
        want = brute(texts[r["doc_id"]] or "")
        listed = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert all(part in r["spans"].split(",") for part in listed.split(",") if part)


def test_terms_that_reveal_are_added(spark):
    rows = [(i, f"plain words of every day number {i} follow one another here and there") for i in range(300)]
    rows += [(1000 + i, f"please write to zanzibarmail user{i}@mail.example for more plain words of every day") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.spans_of(df).collect()}
    text = dict(rows)[1000]
    at = text.index("zanzibarmail")
    assert f"remove:{at}:{at + len('zanzibarmail')}" in got[1000]["pii_spans"].split(",")
    assert "zanzibarmail" not in got[1000]["pii_clean"] and "[EMAIL]" in got[1000]["pii_clean"]
    assert got[5]["pii_clean"] == text[:0] + dict(rows)[5]


def test_odd_rows(odd, empty):
    rows = pii.spans_of(odd).collect()
    assert len(rows) == 9
    seven = next(r for r in rows if r["doc_id"] == 7)
    assert (seven["pii_email"], seven["pii_phone"]) == (1, 1)
    assert seven["pii_base"] == ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in brute(seven["text"]))
    assert pii.spans_of(empty).count() == 0


def test_a_term_is_not_lost_to_others_with_like_hashes(spark):
    """Ten times beside an address, with a frequent word whose hash begins with the same 18 bits."""
    term = "zanzibarmail"
    others = [f"other{i}" for i in range(2_000_000)]
    top = [np.concatenate([h for _, h, _ in _text.words([" ".join(w)])]) >> np.uint64(46) for w in ([term], others)]
    other = others[int(np.flatnonzero(top[1] == top[0][0])[0])]
    rows = [(i, f"{other} " * 40 + f"plain words of every day number {i}") for i in range(300)]
    rows += [(1000 + i, f"please write to {term} user{i}@mail.example for more plain words of every day") for i in range(10)]
    got = {r["doc_id"]: r["pii_spans"] for r in pii.spans_of(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    at = dict(rows)[1000].index(term)
    assert all(f"remove:{at}:{at + len(term)}" in got[1000 + i].split(",") for i in range(10))


def test_disclosures_against_plain_counts(spark, docs, texts):
    planted = [f"write to Zanzibarmail user{i}@mail.example or by halfmail plain words of every day" for i in range(20)] + ["plain words of halfmail"] * 20
    docs = docs.select("text").union(spark.createDataFrame([(t,) for t in planted], "text string"))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    every, near = Counter(), [Counter() for _ in pii.KINDS]
    for text in [*texts.values(), *planted]:
        every.update(w.translate(lower) for w in pii.WORD.findall(text or ""))
        if text and (spans := pii.base_spans(text)):
            places, by = pii.around(text, spans)
            for k, own in by.items():
                near[k].update(text[slice(*places[i])].translate(lower) for i in own)
    want = {}
    for k, counts in enumerate(near):
        share = counts.total() / every.total()
        for word, n in counts.items():
            level = np.log(n / every[word] / share) / -np.log(share)
            if n >= pii.LEAST and level >= pii.GENERALISE:
                want.setdefault(int(pii.term_hashes([word])[0]), [0] * 4)[k] = 1 + int(level >= pii.REMOVE)
    hashes, levels = pii.disclosures(docs)
    assert {max(v) for v in want.values()} == {1, 2}
    assert dict(zip(hashes.tolist(), levels.T.tolist(), strict=True)) == want


def test_terms_are_found_where_no_entity_stands(spark):
    """What gives addresses away elsewhere is taken out of every document; the share found is measured."""
    rows = [(i, f"please write to Zanzibarmail user{i}@mail.example for more plain words of every day {i}") for i in range(40)]
    rows += [(100 + i, f"plain words of every day number {i} again and again") for i in range(400)]
    rows += [(1000 + i, f"ask Zanzibarmail about plain words of day {i}") for i in range(4)]
    got = {r["doc_id"]: r for r in pii.spans_of(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # Of the 44 places of the term, all; of other words without an entity, none.
    assert all(got[1000 + i]["pii_base"] == "" and got[1000 + i]["pii_found"] == 1 and got[1000 + i]["pii_clean"].startswith("ask ") and "Zanzibar" not in got[1000 + i]["pii_clean"] for i in range(4))
    assert all("Zanzibar" not in got[i]["pii_clean"] for i in range(40))
    assert all(got[100 + i]["pii_found"] == 0 for i in range(400))


def test_query_spans_against_plain_python(spark, sf_dir, texts):
    """All spans of the whole table, word by word."""
    hashes, levels = pii.disclosures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    known = dict(zip(hashes.tolist(), levels.max(axis=0).tolist(), strict=True))
    for r in pii.op2_pii(spark, sf_dir).collect():
        text = texts[r["doc_id"]] or ""
        base = pii.base_spans(text)
        want = [(s, k, e) for s, k, e in base]
        for m in pii.WORD.finditer(text):
            level = known.get(int(pii.term_hashes([m[0]])[0])) if known else None
            if level and not any(s < m.end() and m.start() < e for s, _, e in base):
                want.append((m.start(), 3 + level, m.end()))
        names = pii.KINDS + pii.ADDED
        assert r["spans"] == ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(want)) and r["n_spans"] == len(want)

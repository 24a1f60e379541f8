"""Decontamination, personal data and language: against plain loops."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import decontaminate, langid, pii
from usagelens.llm.matches import CONTEXT, PIECES
from usagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_hits(text, items, window=10):
    words, hit, found = WORD.findall(low(text)), set(), set()
    for item, given in items:
        parts = WORD.findall(low(given))
        for i in range(max(1, len(parts) - window + 1) if parts else 0):
            part = parts[i:i + window]
            for at in range(len(words) - len(part) + 1):
                if words[at:at + len(part)] == part:
                    hit.update(range(at, at + len(part)))
                    found.add(item)
    return words, hit, found


@pytest.mark.parametrize("automaton_bytes", [decontaminate.AUTOMATON_BYTES, 60])
def test_contamination(spark, automaton_bytes):
    chance = random.Random(3)
    vocabulary = ["a", "b", "Cé", "d1", "é", "ß"]
    items = [(k, " ".join(chance.choice(vocabulary) for _ in range(n)))
             for k, n in enumerate([12, 14, 11, 10, 3, 2])] + [(6, None), (7, ""), (8, "--"), (None, "zz yy"), (2, "q-Q")]
    texts = [" , ".join(chance.choice(vocabulary) for _ in range(n)) for n in (0, 1, 5, 40, 300, 300)]
    texts += [None, "zz\nYY", f"é {items[0][1]}! {items[1][1]}", items[3][1] + items[3][1], "xa b", "Q q", "q q", "\x00q\x7fQ"]
    docs = spark.createDataFrame([(k, t, -1, "c") for k, t in enumerate(texts)],
                                 "doc_id long, text string, N_WORDS int, item_ids string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, automaton_bytes=automaton_bytes).collect()
    assert len(got) == len(texts)
    for row in got:
        words, hit, found = plain_hits(row.text, items)
        assert row.n_words == len(words)
        assert {k for h in row.hits for k in range(h.first_word, h.last_word + 1)} == hit
        assert row.item_ids == sorted(i for i in found if i is not None)
        for h in row.hits:
            assert WORD.findall(low(row.text[h.start:h.end])) == words[h.first_word:h.last_word + 1]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {row.doc_id for row in kept.collect()} == {row.doc_id for row in got if not row.hits}


def test_contamination_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).collect()[0].hits == []
    assert decontaminate.find_contamination(docs.limit(0), none).collect() == []


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def digits(value):
    return re.sub("[^0-9]", "", value)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
}


def plain_spans(text):
    return [(kind, m.start(), m.end()) for kind, (pattern, good) in BASE.items()
            for m in re.finditer(pattern, text or "") if good(m[0])]


def test_base_spans_equal_plain_search(spark):
    chance = random.Random(8)
    bits = ["1", "2", "0", "255", "256", ".", " ", "-", "a", "b", "@", "_", "+", "4111111111111111", "é", "(", ")", "\n",
            "..", "é😀", "%", "x.y", "+49 30 1234567", "a@b.c"]
    texts = ["".join(chance.choice(bits) for _ in range(chance.randint(0, 60))) for _ in range(1500)] + [
        None, "", "a@b.c_d@e.f", "999.1.1.1.1", "a@b.c.@x.y", "4111 1111-1111 1111", "0" * 16, "1.2.3.4.5.6.7.8"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, PII_SPANS string")
    got = {row.doc_id: row for row in pii.find_pii(docs).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        spans = [(s.kind, s.start, s.end) for s in got[k].pii_spans if s.kind in pii.BASE_KINDS]
        assert spans == plain_spans(text), text


def test_address_parts_of_zeros(spark):
    texts = ["10.0.0.1", "0.0.0.0", "127.0.0.1", "1.2.3.00", "x 192.168.0.12, 000.0.00.0255", "256.0.0.1", "0.0.0.0256",
             "0.0.0", "00.1.2560.0", "100.200.010.001 0.0.0.0.0"]
    chance = random.Random(5)
    parts = ["0", "00", "000", "1", "01", "10", "100", "255", "0255", "256", "0256", "1000"]
    texts += [".".join(chance.choice(parts) for _ in range(chance.randint(3, 6))) for _ in range(400)]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in got:
        spans = [(s.kind, s.start, s.end) for s in row.pii_spans if s.kind == "ip"]
        assert spans == [span for span in plain_spans(row.text) if span[0] == "ip"], row.text
    assert sum(len(row.pii_spans) for row in got if row.doc_id < 4) == 4


def test_very_long_texts(spark):
    texts = ["1" * 200000, "a" * 200000 + "@", "a@" + "b." * 100000 + "c", "1.2.3.4 " * 20000, "a@b.co " * 20000, "1 " * 90000]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [len(row.pii_spans) for row in sorted(found)] == [0, 0, 1, 20000, 20000, 0]
    last = max(found, key=lambda row: row.doc_id == 3).pii_spans[-1]
    assert (last.start, last.end) == (8 * 19999, 8 * 19999 + 7)


def test_added_kinds_need_checksum_or_context(spark):
    texts = {
        1: "IBAN GB82 WEST 1234 5698 7654 32 here", 2: "GB82 WEST 1234 5698 7654 33", 3: "DE89370400440532013000",
        4: "my ssn 123-45-6789", 5: "ref 123-45-6789", 6: "amex card 378282246310005", 7: "no 378282246310005",
        8: "amex card 378282246310006"}
    found = {row.doc_id: [s.kind for s in row.pii_spans if s.kind not in pii.BASE_KINDS]
             for row in pii.find_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == {1: ["iban"], 2: [], 3: ["iban"], 4: ["id_number"], 5: [], 6: ["short_card"], 7: [], 8: []}


def test_context_reaches_over_other_matches(spark):
    amex, far = "378282246310005", "é" * (CONTEXT + 1)
    texts = {
        1: "ssn 123-45-6789, 987-65-4321", 2: f"card: {amex}, {amex}", 3: "ssn 123-45-6789 " + far + " 987-65-4321",
        4: "123-45-6789 ssn 987-65-4321", 5: "ssn " + ",".join(["123-45-6789"] * 6), 6: f"no {amex}, {amex}",
        7: "".join(f"{far} ssn 123-45-6789, 987-65-4321;" for _ in range(PIECES + 7)),
        8: "".join(f"{far}123-45-6789, 987-65-4321;" for _ in range(PIECES + 7))}
    found = {row.doc_id: [s.start for s in row.pii_spans]
             for row in pii.find_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for k, text in texts.items():
        places = [m.start() for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|3782[0-9]{11}", text)]
        assert found[k] == [p for p in places if re.search(r"\b(ssn|card)\b", text[max(0, p - CONTEXT):p])], k
    assert [len(found[k]) for k in texts] == [2, 2, 1, 1, 4, 0, 2 * (PIECES + 7), 0]


def test_context_over_a_part_of_the_matches(spark):
    text = "123-45-6789 " * (PIECES - 1) + "ssn 123-45-6789 987-65-4321 " + "123-45-6789 " * (2 * PIECES)
    row, = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [s.start for s in row.pii_spans] == [12 * (PIECES - 1) + k for k in (4, 16, 28, 40)]


def test_masking(spark):
    texts = [(1, "write a@b.co or +49 30 1234567!", 31), (2, "é 1.2.3.4, 1.2.3.4", 18), (3, None, None), (4, "clean", 5)]
    rows = pii.mask_pii(spark.createDataFrame(texts, "doc_id long, text string, n_chars long"), length_col="n_chars")
    assert [tuple(row) for row in sorted(rows.collect())] == [
        (1, "write <EMAIL> or <PHONE>!", 25), (2, "é <IP>, <IP>", 12), (3, None, None), (4, "clean", 5)]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.train(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def test_language_of_held_out_documents(spark):
    truth = {row.doc_id: row.lang for row in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_langid"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) for row in rows)
    held = [row.lang_pred == truth[row.doc_id] for row in rows if row.held_out]
    assert sum(held) / len(held) > 0.97
    assert all(0 <= row.score <= 1 for row in rows)


def test_language_of_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !! ___"), (4, "Der die und von nicht einer"), (4, "Der die und von nicht einer"),
            (None, "the of and that"), (5, "the of and that " * 30000)]
    docs = spark.createDataFrame([(doc, text, "q", 0.5) for doc, text in rows], "doc_id long, text string, LANG_PRED string, score double")
    got = langid.identify(docs, model).collect()
    assert sorted((row.doc_id or 0, row.lang_pred) for row in got) == [
        (0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en")]
    assert all(row.spans == [] and row.score == 0 for row in got if row.lang_pred == "und")
    assert {row.doc_id for row in langid.keep_identified(docs, model).collect()} == {4, None, 5}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_mixed_text_has_spans_of_both(model):
    german, english = "Der die und von nicht einer ist der mit ", "the of and that with for are this from was "
    (lang, score, spans), = langid.label_texts([german * 3 + english * 6], model)
    assert lang == "en" and 0.5 < score < 1
    assert [s[0] for s in spans] == ["de", "en"]
    assert abs(spans[0][2] - len(german) * 3) < 12


def test_no_labels(spark):
    empty = langid.train(spark.createDataFrame([(None, "a"), ("x", None)], "text string, lang string"))
    assert langid.label_texts(["abc"], empty) == [("und", 0.0, [])]


def test_viterbi_equals_all_paths():
    chance = np.random.default_rng(2)
    scores = chance.normal(size=(50, 3)).astype(np.float32) * 3
    lengths = np.array([6, 0, 1, 5, 7])
    flat = chance.integers(0, 50, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    labels = langid.viterbi(scores, starts, lengths, flat, penalty=2.0)
    for start, length in zip(starts, lengths):
        own = scores[flat[start:start + length]].astype(np.float64)
        best = None
        for code in range(3 ** length):
            path = [code // 3 ** k % 3 for k in range(length)]
            value = sum(own[k, p] for k, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
            best = value if best is None else max(best, value)
        path = labels[start:start + length]
        value = sum(own[k, p] for k, p in enumerate(path)) - 2.0 * int((path[1:] != path[:-1]).sum())
        assert length == 0 or abs(value - best) < 1e-6


def test_scripts_narrow_the_candidates(spark):
    rows = [("мама мыла раму и пошла домой " * 9, "ru"), ("the cat sat on the mat " * 9, "en"), ("η γάτα κάθισε " * 9, "el")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert [r[0] for r in langid.label_texts(["дом", "qqq", "κκκ"], model)] == ["ru", "en", "el"]


def test_masking_many_spans_is_linear_and_right(spark):
    text = "".join(f"é{k} a{k}@b.co, " for k in range(40_000))
    table = spark.createDataFrame([(text, 1, "s")], "text string, __spans int, pii_spans string")
    begin = time.time()
    row = pii.mask_pii(table).first()
    assert row["__spans"] == 1 and row["pii_spans"] == "s" and time.time() - begin < 60
    assert row.text == "".join(f"é{k} <EMAIL>, " for k in range(40_000))


def test_masks_equal_the_plain_loop(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(120):
        text = "".join(rng.choice("aé😀 ") for _ in range(rng.choice([0, 3, 999, 1000, 1001, 2500])))
        spans = []
        for _ in range(rng.choice([0, 1, 3, 250])):
            start = rng.randrange(len(text) + 1)
            spans.append((start, min(len(text), start + rng.choice([1, 5, 1200])), rng.choice(["ip", "card"]), 1.0))
        rows.append((text, [s for s in spans if s[1] > s[0]]))

    def plain(text, spans):
        out, at = "", 0
        for start, end, kind, _ in sorted(spans, key=lambda s: (s[0], -s[1])):
            if start >= at:
                out += text[at:start] + f"<{kind.upper()}>"
            at = max(at, end)
        return out + text[at:]

    table = spark.createDataFrame(rows, f"text string, spans array<{pii.SPAN}>")
    for row in table.select("text", "spans", pii.masked(F.col("text"), F.col("spans")).alias("out")).collect():
        starts = {(s[0], s[1]) for s in row.spans}
        if len(starts) == len(row.spans):
            assert row.out == plain(row.text, [tuple(s) for s in row.spans])


def test_filters_leave_columns_alone(spark):
    rows = [(k, text, 1.5, "l", 7, [1], "i") for k, text in enumerate(["the and of words here", "½ ² ①", "Ⅷ", None])]
    table = spark.createDataFrame(rows, "doc_id long, text string, score double, lang_pred string, n_words int, hits array<int>, item_ids string")
    learned = spark.createDataFrame([("the and of words here", "en"), ("le la les des mots", "fr")], "text string, lang string")
    model = langid.train(learned)
    kept = langid.keep_identified(table, model)
    assert kept.columns == table.columns and [tuple(r) for r in kept.collect()] == rows[:1]
    labels = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(table, model, keep=["doc_id"]).collect()}
    assert labels[1] == labels[2] == labels[3] == ("und", 0.0)
    clean = decontaminate.drop_contaminated(table, spark.createDataFrame([(1, "nothing alike")], "item_id long, text string"))
    assert clean.columns == table.columns and sorted(map(str, clean.collect())) == sorted(map(str, table.collect()))

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailguard.llm import chat_format, class_lm, common, decontaminate, fingerprints, language_id, license_scan, license_texts, packing, simhash, substring_dedup, token_files
from trailguard.llm.common import scratch_path
from trailguard.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import check
from . import helpers as h

SCHEMA = "doc_id long, text string, lang string, score double, n_words long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
#: Nulls, empty and very long texts, ties and repeated rows, and columns whose names operators use themselves.
ODD = [
    (1, None, None, 0.1, 5), (2, "", "en", None, 5), (3, "One two three", "en", 0.1, None), (4, "One two three", "en", 0.1, 5), (None, "no id here", "en", 0.1, 5),
    (5, LONG, "en", 0.1, 5), (6, LONG + " tail", "de", 0.1, 5), (7, "a " * 90, "de", 0.1, 5), (8, "  \n\t ", "de", 0.1, 5), (9, "1234 !! ,,", "de", 0.1, 5), (10, "日本 é <|endoftext|> İ", None, 0.1, 5),
]
TWICE = [*ODD, ODD[3]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def twice(spark):
    return spark.createDataFrame(TWICE, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def check_tokens(docs, rows):
    tok, at = h.tokenizer(), 0
    got = sorted(rows, key=lambda r: r["start"])
    order = sorted(docs, key=lambda d: -(2**63) if d[0] is None else d[0])
    assert [r["doc_id"] for r in got] == [d[0] for d in order]
    for r, (_, text) in zip(got, order, strict=True):
        ids = h.ids_of(tok, text)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), h.crc(ids))
        at += len(ids)


def test_token_files(spark, sf_dir, docs, odd, none):
    check_tokens(docs, QUERIES["op4_token_files"](spark, sf_dir).collect())
    for df, want in ((odd, [d[:2] for d in ODD]), (none, [])):
        folder = scratch_path(spark, "test")
        check_tokens(want, token_files.read(spark, folder, token_files.write(df, folder)).collect())


def check_packing(docs, rows, size=2048):
    tok = h.tokenizer()
    ids = {d: h.ids_of(tok, t) for d, t in docs}
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == h.crc(own[r["start"] : r["start"] + r["length"]])
        at[r["doc_id"]] += r["length"]
    assert at == {d: len(x) for d, x in ids.items()}
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert all(n <= size for n in fill.values())
    tokens = sum(map(len, ids.values()))
    assert len(fill) <= -(-tokens // size) + 1


def test_packing(spark, sf_dir, docs, odd, none, twice):
    check_packing(docs, QUERIES["op1_packing"](spark, sf_dir).collect())
    check_packing([d[:2] for d in ODD], packing.pack(odd).collect())
    assert packing.pack(none).collect() == []
    assert packing.pack(twice, with_ids=False).agg(F.sum("length")).first()[0] == sum(len(h.ids_of(h.tokenizer(), d[1])) for d in TWICE)


def test_packing_plan_fills_packs():
    r = random.Random(2)
    for _ in range(20):
        hist = {length: r.randint(1, 40) for length in r.sample(range(1, 100), 30)}
        packs, plan = packing.shortest_pack_first(hist, 100)
        total = sum(k * v for k, v in hist.items())
        assert packs == -(-total // 100) and sum(n * tokens for _, _, n, _, tokens, _, _ in plan) == total
        p, fill = packing.Plan(plan), Counter()
        for length, n in hist.items():
            for rank in range(n):
                for _, tokens, pack, _ in p.pieces(length, rank):
                    fill[pack] += tokens
        assert max(fill.values()) <= 100 and sum(fill.values()) == total


def test_language_id(spark, sf_dir, odd, none):
    rows = QUERIES["op2_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 for r in rows)
    dictionaries = language_id.learn(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))
    got = {r["row"]["doc_id"]: r for r in language_id.identify(odd, dictionaries).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (1, 2, 8, 9)) and got[5]["row"]["score"] == 0.1
    assert language_id.identify(none, dictionaries).collect() == [] and language_id.learn(none) == {}
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}


def test_language_id_learns_from_a_language_of_copies(spark):
    copies = spark.range(40_000).select(F.concat(F.lit("word number "), F.element_at(F.array(*map(F.lit, ("one", "two", "three"))), (F.col("id") % 3 + 1).cast("int"))).alias("text"), F.lit("en").alias("lang"))
    found = language_id.learn(copies.union(spark.createDataFrame([("ein anderer Satz", "de")], "text string, lang string")))
    assert set(found) == {"de", "en"} and all(w in found["en"] for w in (b"one", b"two", b"three"))


def test_language_id_counts_the_words_of_all_labelled_texts(spark, sf_dir):
    import string

    r = random.Random(3)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and text is not null").select("text", "lang").collect()
    rows += [("".join(r.choices(string.ascii_lowercase, k=8)) + " ja" * (k % 3), "xx") for k in range(30_000)]
    want = {}
    for text, lang in rows:
        want.setdefault(lang, Counter()).update(language_id.letters(text).decode().split())
    table = spark.createDataFrame([tuple(r) for r in rows], "text string, lang string")
    got = {}
    for x in language_id.word_counts(table).collect():
        got.setdefault(x["lang"], Counter())[x["w"]] = x["n"]
    assert got == {lang: words for lang, words in want.items() if words}
    for lang, found in language_id.learn(table).items():
        ranked = sorted(want[lang], key=lambda w: (-want[lang][w], len(w.encode()), w.encode()))
        whole = f" {' '.join(ranked[::-1])} ".encode()
        assert found == whole[-language_id.DICTIONARY :]


def test_common_shingles_are_counted_over_all_texts(spark, docs):
    import pyarrow as pa

    texts = {t for _, t in docs if t}
    want = Counter()
    for t in texts:
        want.update(set(simhash.shingles(pa.array([t]), 5)[0].view("int64").tolist()))
    shingles, n = simhash.common_shingles(spark.createDataFrame(docs, "doc_id long, text string"), 5)
    assert dict(zip(shingles.tolist(), n.tolist(), strict=True)) == {k: c for k, c in want.items() if c > 2}


def test_shingle_cells_count_all_shingles_of_all_texts(spark, docs):
    import numpy as np
    import pyarrow as pa

    texts = [*dict(docs).values(), None, "", " ".join(f"w{k}" for k in range(200_000))]
    want = np.zeros(simhash.CELLS, np.int64)
    for t in set(texts) - {None}:
        h = np.unique(simhash.shingles(pa.array([t]), 5)[0]).view(np.int64)
        want += np.bincount(h & (simhash.CELLS - 1), minlength=simhash.CELLS)
    rows = [(i, t) for i, t in enumerate(texts * 300) if i < len(texts) or i % 7 == 0 and len(t or "") < 1000]
    got = simhash.shingle_cells(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    assert np.array_equal(got, want) and want.max() > 1
    assert not simhash.shingle_cells(spark.createDataFrame([], "doc_id long, text string"), 5).any()


def test_prefixes_leave_out_a_templates_shingles_however_many_are_common(spark, monkeypatch):
    from .test_pipeline import form_texts

    monkeypatch.setattr(simhash, "COMMON", 10, raising=False)  # stands for a corpus with more common shingles than a list holds
    rows = list(form_texts(100, random.Random(6)).items())
    prints = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 3, 5, 0.8)
    shared = prints.select(F.explode("prefix").alias("h")).groupBy("h").count().where("count > 20").count()
    assert shared < 20


def test_substring_dedup(spark, sf_dir, docs, odd, none, twice):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op3_substring_dedup"](spark, sf_dir).collect()}
    assert got == h.dedup(docs) and sum(x[1] for x in got.values()) > 0
    rows = substring_dedup.remove_repeats(odd).collect()
    want = h.dedup([d[:2] for d in ODD])
    assert {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == want
    assert next(r for r in rows if r["row"]["doc_id"] == 8)["row"]["text"] == "  \n\t " and next(r for r in rows if r["row"]["doc_id"] == 3)["row"]["n_words"] is None
    assert substring_dedup.remove_repeats(none).collect() == []
    assert substring_dedup.remove_repeats(twice, keep_rows=False).where("d = 4").count() == 2


def test_substring_dedup_on_periodic_and_random_texts(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 90))) for _ in range(40)] + ["a " * r.randint(1, 60) for _ in range(10)] + ["x y z " * r.randint(1, 30) for _ in range(10)]
    texts += [texts[3] + " q " + texts[5], texts[0]]
    docs = list(enumerate(texts))
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=7, keep_rows=False).collect()
    assert {r["d"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == h.dedup(docs, 7)


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_that_are_patterns_of_two_letters_differ():
    import numpy as np
    import pyarrow as pa

    words = [thue_morse(n, *ab) for n in (16, 64, 128, 1024, 2048, 4096) for ab in ("ab", "ba")]
    found = common.Words(pa.array([" ".join(words)]), common.NOT_SPACE, False)
    assert len(np.unique(found.hash)) == len(words) and [found.text(i).decode() for i in range(len(words))] == words
    moved = common.Words(pa.array(["", "x " + " ".join(reversed(words))]), common.NOT_SPACE, False)
    assert moved.hash[:0:-1].tolist() == found.hash.tolist()


def test_substring_dedup_tells_long_words_apart(spark):
    rest = " ".join(f"w{i}" for i in range(19))
    docs = [(1, f"{thue_morse(1024)} {rest}"), (2, f"{thue_morse(1024, 'b', 'a')} {rest}"), (3, f"{thue_morse(1024)} {rest}")]
    got = {r["d"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), keep_rows=False).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_substring_dedup_when_names_collide(spark, monkeypatch):
    import numpy as np
    from pyspark import cloudpickle

    from trailguard.llm import common as c

    cloudpickle.register_pickle_by_value(substring_dedup)  # so that workers take the patched module along
    cloudpickle.register_pickle_by_value(c)
    full = c.word_hashes
    monkeypatch.setattr(c, "word_hashes", lambda *x: full(*x) & np.uint64(7))
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 120))) for _ in range(40)]
    texts += [" ".join([*texts[k].split()[10:60], "new", *texts[k + 1].split()[20:]]) for k in range(20)]
    docs = list(enumerate(texts))
    try:
        got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), keep_rows=False).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(substring_dedup)
        cloudpickle.unregister_pickle_by_value(c)
    want = h.dedup(docs)
    assert {x["d"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got} == want and sum(x[1] for x in want.values()) > 100


def test_decontamination_in_parts_equals_one_part(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = lambda df: sorted((r["row"]["doc_id"], r["n_words"], sorted(map(tuple, r["hits"])), sorted(r["items"])) for r in df.collect())
    whole, parts = decontaminate.find(docs, benchmark), decontaminate.find(docs, benchmark, most=500)
    assert key(whole) == key(parts) and any(x[3] for x in key(whole))
    items = spark.createDataFrame([("a", "ONE, two"), ("b", None), ("c", ""), ("d", "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15")], "item_id string, text string")
    got = {r["row"]["doc_id"]: r for r in decontaminate.find(odd, items).collect()}
    assert got[3]["items"] == ["a"] and got[5]["items"] == ["d"] and got[1]["n_words"] == 0 and got[1]["row"]["text"] is None
    assert decontaminate.find(none, items).collect() == [] and all(not r["hits"] for r in decontaminate.find(odd, items.limit(0)).collect())
    spans = spark.createDataFrame([([{"first": 0, "m": 3}, {"first": 1, "m": 5}, {"first": 9, "m": 1}],)], "hits array<struct<first:int,m:int>>")
    assert spans.select(decontaminate.hit_words()).first()[0] == 7


def test_chat_layouts(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"a <|end|> [INST] <\\\\|x"}],"id":9}'),
        (2, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}],"system":"be kind"}'),
        (3, '{"instruction":"add","input":"1 1","output":"2"}'),
        (4, '{"prompt":"p","response":"r"}'),
        (5, '{"odd":1}'),
        (6, None),
        (7, '{"question":"q","answer":"</s>"}'),
    ]
    turns = chat_format.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string"))
    formatted = chat_format.format_turns(turns)
    got = {r["conv_id"]: r for r in chat_format.parse(formatted).collect()}
    said = {k: [(t["role"], t["text"]) for t in v["turns"]] for k, v in got.items()}
    assert said[1] == [("user", "hi"), ("assistant", "a <|end|> [INST] <\\|x")] and got[1]["loss_text"] == "a <|end|> [INST] <\\|x"
    assert said[2] == [("system", "be kind"), ("user", "hi"), ("assistant", "yo")]
    assert said[3] == [("user", "add\n1 1"), ("assistant", "2")] and said[4] == [("user", "p"), ("assistant", "r")]
    assert said[5] == said[6] == [] and got[5]["formatted"] == "" and got[7]["loss_text"] == "</s>"
    assert "[INST]" not in got[1]["formatted"] and "</s>" not in got[7]["formatted"]
    table = spark.createDataFrame([(1, None, "user", None), (1, None, None, "x"), (None, 2, "assistant", "é" * 50000)], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.parse(chat_format.format_turns(chat_format.canonical_turns(chat_format.records_of_rows(table)))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("", "x"), ("user", "")] and out[None]["loss_text"] == "é" * 50000
    assert chat_format.records_of_rows(table.limit(0)).count() == 0


def edited(pairs):
    """(doc_id, text, edited text, next text) in the operator's order, but for rows of one doc_id with different texts."""
    order = sorted(pairs, key=lambda d: (-(2**63) if d[0] is None else d[0], d[1] or ""))
    texts = [t or "" for _, t in order]
    for k, (i, _) in enumerate(order):
        t, n = texts[k], texts[(k + 1) % len(texts)]
        yield i, t, t[: len(t) - len(t) // 2] + n[: len(t) // 2], n


def ends_in_common(a, b):
    """The share of the longer text that two different texts have in common at their ends."""
    from os.path import commonprefix

    n = len(commonprefix([a, b])) + len(commonprefix([a[::-1], b[::-1]]))
    return min(n, len(a), len(b), max(len(a), len(b)) - 1) / max(len(a), len(b)) if a and b else 0.0


def test_fingerprints(spark, sf_dir, docs, odd, none, twice):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: r for r in QUERIES["op7_fingerprints"](spark, sf_dir).collect()}
    likeness = lambda x, y, a, b: 1.0 if a == b else max(ends_in_common(a, b), fingerprints.overlap(x, y) if a and b else 0)
    for i, text, half, following in edited(docs):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), digest(half))
        assert r["near_edited"] == pytest.approx(likeness(r["fingerprint"], r["edited_fingerprint"], text, half))
        assert r["edited_fingerprint"] == fingerprints.fingerprint(fingerprints.Prefixes(fingerprints.code_points(half)))
        nxt = fingerprints.fingerprint(fingerprints.Prefixes(fingerprints.code_points(following)))
        assert r["near_next"] == pytest.approx(likeness(r["fingerprint"], nxt, text, following))
    assert len({r["fingerprint"] for r in got.values()}) == len({t for _, t in docs})
    null = lambda rows: sorted((r[0] if r[0] is not None else -(2**63), r[1], r[2]) for r in rows)
    for df, rows in ((odd, ODD), (twice, TWICE)):
        want = null((i, len(t), digest(e)) for i, t, e, _ in edited([d[:2] for d in rows]))
        assert null((r["d"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.edit_half(df).collect()) == want
    assert fingerprints.edit_half(none).collect() == []


def test_fingerprints_of_one_doc_id_are_spread(spark):
    rows = [(7, f"text {i} of many") for i in range(300)] + [(1, "first"), (9, "last one")]
    df = fingerprints.edit_half(spark.createDataFrame(rows, "doc_id long, text string"))
    got = df.withColumn("part", F.spark_partition_id()).where("d = 7").collect()
    assert len(got) == 300 and len({r["part"] for r in got}) > 1
    texts = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for _, a in rows for _, b in rows}
    assert all(r["edited_sha256"] in texts for r in got)


def test_prefix_hashes_answer_spans_and_extensions():
    import numpy as np

    r = random.Random(1)
    whole = lambda t: fingerprints.Prefixes(fingerprints.code_points(t))
    for _ in range(60):
        a, b = ("".join(r.choice("abé日") for _ in range(r.randint(0, 200))) for _ in range(2))
        x, y = whole(a), whole(b)
        k, m = r.randint(0, len(a)), r.randint(0, len(b))
        assert fingerprints.fingerprint(fingerprints.Joined(x, k, y, m)) == fingerprints.fingerprint(whole(a[:k] + b[:m]))
        n = 0
        while k + n < len(a) and m + n < len(b) and a[k + n] == b[m + n]:
            n += 1
        assert x.common(k, y, m) == n
        n = 0
        while n < min(k, m) and a[k - n - 1] == b[m - n - 1]:
            n += 1
        assert x.common(k, y, m, back=True) == n
    far = whole("ab" * 100_000)  # beyond the table of powers
    same = far.spans(np.array([0, 150_000]), np.array([40, 150_040]))
    assert all(h[0] == h[1] for h in same) and far.common(2, far, 160_000) == 40_000 and far.common(1, far, 160_000) == 0


def test_likeness_of_scattered_edits_and_moved_passages():
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    text, other = " ".join(words[:800]), " ".join(words[800:1600])

    def like(a, b):
        x, y = (fingerprints.Prefixes(fingerprints.code_points(t)) for t in (a, b))
        return fingerprints.likeness(fingerprints.fingerprint(x), fingerprints.fingerprint(y), x, y)

    scattered = " ".join(["new", *words[1:300], "word", *words[301:600], "put", *words[601:799], "in"])
    moved = " ".join([*words[400:800], *words[:400]])
    assert like(text, text) == 1 and like(text, other) < 0.1 and like(text, "") == 0 and like("", "") == 1
    assert like(text, scattered) > 0.7 and like(text, moved) > 0.7 and 0.9 < like("x" * 100, "x" * 99 + "y") < 1


def test_license_scan(spark, sf_dir, docs, odd, none):
    got = {r["doc_id"]: r for r in QUERIES["op8_license_scan"](spark, sf_dir).collect()}
    for i, text in docs:
        w, at, labels = h.alnum_words(text), [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            places = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += places
            labels |= {label} if places else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert labels <= set(r["labels"].split(",")) | {""} or labels <= set(r["labels"].split(","))
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(none).collect() == []


def license_labels(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [{m["label"] for m in r["matches"]} for r in sorted(license_scan.scan(df, **more).collect(), key=lambda r: r["doc_id"])]


def test_license_scan_of_notices_that_are_changed(spark):
    mit, bsd = license_texts.MIT, next(text for label, text, _ in license_texts.TEMPLATES if label == "bsd")
    grant = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
    texts = [
        mit, grant, grant.replace("hereby", "hereby also").replace("copy", "copy or two"), grant.replace("free of charge", "for money"),
        "unencumbered " * 64 + grant, "unencumbered " * 64 + mit.upper().replace(" ", "\n# "),
        "x " * 500 + bsd.upper() + " y", bsd.replace("binary", "boxed"), "redistribution and use", "permission " * 200,
        " ".join(w for k, w in enumerate(mit.split()) if k % 9), " ".join(w for k, w in enumerate(mit.split()) if k % 4),
    ]
    want = [{"mit"}, {"mit"}, {"mit"}, set(), {"mit"}, {"mit"}, {"bsd"}, set(), set(), set(), {"mit"}, set()]
    assert license_labels(spark, texts) == want
    phrases = spark.createDataFrame([(1, "Well, hello WORLD. Hello"), (2, "world hello")], "doc_id long, text string")
    assert [(r["doc_id"], [b["first"] for b in r["base"]]) for r in sorted(license_scan.scan(phrases, phrases={"hello world": "greeting"}).collect())] == [(1, [1]), (2, [])]


def test_licenses_within_others_are_not_labelled(spark):
    of = {}
    for label, text, _ in license_texts.TEMPLATES:
        of.setdefault(label, []).append(text)
    texts = [
        of["cc-by-sa"][0], of["cc-by-nc"][1], of["cc-by"][0], of["bsd-3-clause"][0], of["bsd-2-clause"][0], of["bsd-3-clause"][0] + " code " * 50 + of["bsd-2-clause"][0],
        of["bsd-3-clause"][0] * 3, of["cc-by"][0] + ". " + of["cc-by-sa"][0], license_texts.MIT + license_texts.APACHE_NOTICE, of["gpl-3"][0] + " Preamble The GNU General Public License is a free, copyleft license",
        *[text for _, text, _ in license_texts.OPENINGS],
    ]
    want = [{"cc-by-sa"}, {"cc-by-nc"}, {"cc-by"}, {"bsd-3-clause"}, {"bsd-2-clause"}, {"bsd-3-clause", "bsd-2-clause"}, {"bsd-3-clause"}, {"cc-by", "cc-by-sa"}, {"mit", "apache-2"}, {"gpl-3"}]
    assert license_labels(spark, texts) == want + [{label} for label, *_ in license_texts.OPENINGS]


def agreeing(window, template):
    row = [0] * (len(template) + 1)
    for w in window:
        diagonal = 0
        for j, x in enumerate(template):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if w == x else max(row[j], row[j + 1])
    return row[-1]


def test_license_scan_equals_all_windows_compared(spark):
    templates = [("a", "one two three four five six seven eight nine ten", ["two three"]), ("b", "one three five seven nine two four", []), ("c", "all rights reserved", ["all rights reserved"]), ("d", "two two one two", [])]
    r = random.Random(3)
    words = "one two three four five six seven eight nine ten all rights reserved x y".split()
    texts = [" ".join(r.choices(words, k=r.randint(0, 120))) for _ in range(40)]
    texts += [" ".join(w for w in (" ".join(t for _, t, _ in r.sample(templates, 4)) + " x").split() if r.random() > 0.1 for w in [w, *r.choices(words, k=r.random() < 0.1)]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(m["label"], m["first"], m["cover"]) for m in r["matches"]] for r in license_scan.scan(df, templates=templates).collect()}
    def best_place(w, alive, t, phrases):
        size = len(t) + len(t) // 4
        starts = [k for k in alive if w[k] in t]
        windows = [[j for j in alive if k <= j < k + size] for k in starts]
        covers = [agreeing([w[j] for j in x], t) for x in windows]
        passing = [(-c, k) for k, c in zip(starts, covers, strict=True) if c >= 0.8 * len(t) and all(f" {p} " in f" {' '.join(w[k : k + size])} " for p in phrases)]
        if not passing:
            return None
        c, k = min(passing)
        j = starts.index(k)
        while j + 1 < len(starts) and covers[j + 1] == -c:
            j += 1
        own = windows[j]
        end = next(own[e - 1] + 1 for e in range(1, len(own) + 1) if agreeing([w[x] for x in own[:e]], t) == -c)
        return -c, starts[j], end

    for i, text in enumerate(texts):
        w, want = h.alnum_words(text), {}
        alive = list(range(len(w)))
        while True:
            places = {t: p for t, (_, notice, phrases) in enumerate(templates) if (p := best_place(w, alive, notice.split(), phrases))}
            if not places:
                break
            t = max(places, key=lambda t: (places[t][0], places[t][0] / len(templates[t][1].split()), -t))
            c, first, end = places[t]
            want.setdefault(t, (templates[t][0], first, c / len(templates[t][1].split())))
            alive = [k for k in alive if not first <= k < end]
        assert found[i] == [want[t] for t in sorted(want)]
    assert sum(map(len, found.values())) > 50


def test_class_lm(spark, sf_dir, docs, odd, none):
    got = {r["doc_id"]: r for r in QUERIES["op9_class_lm"](spark, sf_dir).collect()}
    import zlib

    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = {i: [*h.space_words(t), "\0"] for i, t in docs}
    c = Counter(w for i, ts in tokens.items() if i not in held for w in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(ts), sum(w in c for w in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts))
        assert r["score"] < 0
    base, model = (sum(got[i][k] for i in held) for k in ("base_score", "score"))
    assert model > base
    rows = odd.select("doc_id", F.lit(False).alias("held_out"), "text")
    for train in (rows, rows.limit(0)):
        m, words = class_lm.train(train)
        scored = class_lm.score(rows.union(rows), m, words).collect()
        assert len(scored) == 2 * len(ODD) and all(math.isfinite(r["score"]) for r in scored)
        assert len({(r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in scored}) == len(ODD)
    assert class_lm.score(rows.limit(0), m, words).collect() == []


def word_hash(word):
    import pyarrow as pa

    return int(common.signed(common.Words(pa.array([word]), common.NOT_SPACE, True).hash)[0])


def test_class_lm_scores_equal_the_formula_and_add_up(spark, sf_dir, docs, monkeypatch):
    import numpy as np

    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 > 0").select("text")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(False).alias("held_out"), "text")
    monkeypatch.setattr(class_lm, "HEAD", 300)
    monkeypatch.setattr(class_lm, "KNOWN", 600)  # most words come by joins
    m, words = class_lm.train(texts, size=300, classes=12)
    of = {r["w"]: (r["n"], r["class"]) for r in words.collect()}
    tokens = {i: [*h.space_words(t), None] for i, t in docs}
    seen = Counter(w for i, ts in tokens.items() if i % 3 for w in ts)
    assert len(of) == len(seen) == m.v and len(m.words) <= 600 < m.v / 2
    hashes = {w: int(class_lm.END) if w is None else word_hash(w) for ts in tokens.values() for w in ts}
    assert all(of[hashes[w]][0] == n for w, n in seen.items())
    # probabilities: of all classes after each class, of all words and one not seen in each class
    assert np.allclose((10**m.transitions).sum(1), 1)
    mass = Counter()
    for n, c in of.values():
        mass[c] += (n + 1) / 10 ** m.total[c]
    mass[m.unseen] += 1 / 10 ** m.total[m.unseen]
    assert all(x == pytest.approx(1) for x in mass.values())
    got = {r["doc_id"]: r["score"] for r in class_lm.score(rows, m, words).collect()}
    for i, ts in tokens.items():
        before, want = of[int(class_lm.END)][1], 0.0
        for w in ts:
            n, c = of.get(hashes[w], (0, m.unseen))
            want += m.transitions[before, c] + math.log10(n + 1) - m.total[c]
            before = c
        assert got[i] == pytest.approx(want)


def test_class_lm_counts_every_bigram(spark, sf_dir, docs):
    import numpy as np

    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    m, words = class_lm.train(texts, size=100, classes=6)  # most bigrams are of two words outside the head
    of = {r["w"]: r["class"] for r in words.collect()}
    hashes = {w: of[word_hash(w)] for _, t in docs for w in set(h.space_words(t))}
    pairs, end = np.zeros((6, 6)), of[int(class_lm.END)]
    for _, t in docs:
        c = [end, *(hashes[w] for w in h.space_words(t)), end]
        np.add.at(pairs, (c[:-1], c[1:]), 1)
    assert pairs.sum() == m.n
    assert np.allclose(m.transitions, class_lm.log_transitions(pairs) / np.log(10))


def test_class_lm_classes_of_words_with_no_neighbour_in_the_head(spark):
    r = random.Random(8)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abcd"]
    texts = [" ".join(r.choice(kinds[k][: r.choice((15, 30))]) for _ in range(10) for k in (0, 1, 2, 3)) for _ in range(400)]
    rare, new = [kind[15:] for kind in kinds], {0: ["u0", "u1", "u2"], 2: ["v0", "v1", "v2"]}
    for k, ws in new.items():
        texts += [" ".join([r.choice(kinds[0][:15]), r.choice(kinds[1][:15]), r.choice(rare[(k + 3) % 4]), w, r.choice(rare[(k + 1) % 4]), r.choice(kinds[(k + 2) % 4][:15])]) for w in ws for _ in range(30)]
    _, words = class_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), size=61, classes=4)
    of = {x["w"]: x["class"] for x in words.collect()}
    own = {k: Counter(of[word_hash(w)] for w in kinds[k]).most_common(1)[0][0] for k in new}
    assert own[0] != own[2] and all(of[word_hash(w)] == own[k] for k, ws in new.items() for w in ws)


def test_class_lm_puts_words_of_a_kind_together(spark):
    r = random.Random(7)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abcd"]
    texts = [" ".join(r.choice(kinds[k]) for _ in range(10) for k in (0, 1, 2, 3)) for _ in range(400)]
    _, words = class_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), size=60, classes=6)
    of = {x["w"]: x["class"] for x in words.collect()}
    own = [Counter(of[word_hash(w)] for w in kind).most_common(2) for kind in kinds]
    # half of the words aren't in the head
    assert all(sum(n for _, n in c) >= 28 for c in own) and len({c[0][0] for c in own}) == 4


def test_simhash(spark, sf_dir, docs, odd, none, twice):
    prints = {i: h.simhash(t) for i, t in docs}
    want = h.groups(prints)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in QUERIES["op10_simhash"](spark, sf_dir).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints} and any(i != c for i, c in want.items())
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect()}
    assert rows[1]["component_id"] == rows[2]["component_id"] == rows[8]["component_id"] == 1 and rows[1]["fingerprint"] == "0" * 16 and rows[4]["component_id"] == 3
    assert simhash.near_duplicates(none).collect() == [] and simhash.near_duplicates(twice).count() == len(TWICE)


def test_parity_bits_differ_no_more_than_the_shingles_do():
    import numpy as np
    import pyarrow as pa

    r, none = random.Random(1), np.zeros(0, np.int64)
    texts = ["", "a b", " ".join(r.choices("abcdefghij", k=400))] + [" ".join(r.choices([f"w{i}" for i in range(50)], k=r.randint(1, 900))) for _ in range(40)]
    texts += [" ".join([*t.split()[:-3], "x", "y"]) for t in texts[2:]]
    shingles, at = simhash.shingles(pa.array(texts), 5)
    n, _, parity = simhash.prefixes(shingles, at, 0.8, none, none)
    bits = np.array(parity.to_pylist(), np.int64).view(np.uint64)
    own = [set(shingles[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    for i in range(len(texts)):
        assert n[i].as_py() == len(own[i])
        for j in range(i):
            differ = sum(int(x).bit_count() for x in bits[i] ^ bits[j])
            assert differ <= len(own[i] ^ own[j]) and differ % 2 == len(own[i] ^ own[j]) % 2


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[1000 + i] for i in range(51)}) == 1 and got[0] != got[1000]


def test_near_links_are_all_found(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ (1 << r.randrange(64)) for b in base[:10]] + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base[5:20]]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long")
    edges = simhash.components(simhash.links(df, 2)).collect()
    want = h.groups({f: f for f in fps})
    roots = {r["node"] % (1 << 64): r["root"] for r in edges}
    for a in want:
        for b in want:
            assert (want[a] == want[b]) == (roots.get(a, a) == roots.get(b, b))


def test_repeated_rows_do_not_multiply_spans(spark):
    text = " ".join(f"r{i}" for i in range(200))
    spans = {}
    for k in (50, 100):
        df = spark.createDataFrame([(1, text)] * k + [(2, text)], "doc_id long, text string")
        spans[k] = substring_dedup.repeats(df).count()
        got = substring_dedup.remove_repeats(df).groupBy("d", "n_removed").count().collect()
        assert {tuple(r) for r in got} == {(1, 0, k), (2, 200, 1)}
    assert spans[50] == spans[100] <= 200


def test_chat_records_have_several_layouts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    records = chat_format.records_of_rows(rows)
    turns = chat_format.canonical_turns(records)
    assert turns.select("schema_fingerprint").distinct().count() >= 3
    told = {}
    for r in rows.orderBy("conv_id", "turn", "role", "text").collect():
        told.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in turns.collect()} == told
    odd = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "assistant", "b"), (3, 0, "user", ""), (3, 1, "assistant", None), (7, 0, "system", "s"), (7, 1, "user", "u"), (7, 2, "assistant", "{\"a\":1}"), (2, None, "user", "x" * 200_000), (2, 3, "gpt", "z"), (6, 1, "user", "y")], "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.canonical_turns(chat_format.records_of_rows(odd)).collect()}
    assert got == {1: [("human", "a"), ("assistant", "b")], 3: [("user", ""), ("assistant", "")], 7: [("system", "s"), ("user", "u"), ("assistant", "{\"a\":1}")], 2: [("user", "x" * 200_000), ("gpt", "z")], 6: [("user", "y")]}

import corpus_pipeline
from trailguard.llm.language_id import identify, learn

from . import helpers as h
from .test_operators import check_packing


def brute_force(spark, sf_dir):
    """What is left before packing, by plain Python but for the classifier."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["row"]["doc_id"]: r["row"]["text"] for r in identify(table, learn(table.select("text", "lang"))).where("not rejected").collect()}
    groups = h.groups({i: h.simhash(t) for i, t in kept.items()}, also=h.similar(kept))
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    first, out = set(), {}
    for i in sorted(kept):
        w = h.space_words(kept[i], lower=False)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in first:
                gone[s : s + 20] = [True] * 20
            first.add(k)
        if not any(gone):
            out[i] = kept[i]
        elif not all(gone):
            out[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = h.alnum_words(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()

    def clean(text):
        w = h.alnum_words(text)
        return not any(tuple(w[k : k + m]) in windows for m in {len(x) for x in windows} for k in range(len(w) - m + 1))

    return {i: t for i, t in out.items() if clean(t)}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    want = brute_force(spark, sf_dir)
    assert {r["doc_id"] for r in rows} == set(want) and len(want) > 0.7 * docs.count()
    check_packing(list(want.items()), rows)


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "Clean words that stay here", "en", "s", 26), (3, "Clean words that stay here", "en", "s", 26), (4, "123", "en", None, 3)]
    for n, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            path = str(tmp_path / f"{n}-{k}")
            out.write.parquet(path)
            assert k == 4 or out.columns == docs.columns, name
            docs = spark.read.parquet(path)
        assert {r["doc_id"] for r in docs.collect()} == ({3} if data else set())


def test_near_copies_go_and_clean_documents_stay(spark, sf_dir):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    base = [[word() for _ in range(400)] for _ in range(12)]
    rows, copies = [], set()
    for k, w in enumerate(base):
        rows.append((100 * k, " ".join(w)))
        for j in range(1, 6):  # one word in 60 anew: a similarity of some 0.85
            edited = list(w)
            for at in range(rng.randrange(60), len(w), 60):
                edited[at] = word()
            assert 0.8 <= h.jaccard(" ".join(w), " ".join(edited)) < 0.9
            rows.append((100 * k + j, " ".join(edited)))
            copies.add(100 * k + j)
        half = w[:200] + [word() for _ in range(200)]  # shares a passage, but is no near copy
        rows.append((100 * k + 50, " ".join(half)))
    out = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in rows} - copies


def form_texts(groups, rng):
    """Texts of 300 shingles on one template, its words for 85 % of them, each with a near copy."""
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    template, texts = [word() for _ in range(260)], {}
    for k in range(groups):
        own = [*template, *(word() for _ in range(44))]
        copy = list(own)
        for at in (20, 70, 120, 170, 220):  # 25 of 300 shingles: 0.846
            copy[at] = word()
        texts[2 * k], texts[2 * k + 1] = " ".join(own), " ".join(copy)
    return texts


def test_near_copies_among_many_groups_on_one_template(spark, sf_dir):
    import random

    texts = form_texts(750, random.Random(6))
    assert h.jaccard(texts[0], texts[1]) >= 0.8 > h.jaccard(texts[0], texts[2])
    out = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), sf_dir)
    want = h.groups({i: h.simhash(t) for i, t in texts.items()}, also=[(i, i + 1) for i in range(0, len(texts), 2)])
    assert {r["doc_id"] for r in out.collect()} == {i for i in want if want[i] == i}


def test_near_copies_of_any_text_with_one_fingerprint_go(spark, sf_dir):
    filler, w = "a " * 400, [f"w{i}" for i in range(200)]
    third = "a " * 10 + " ".join(w)  # without the filler that sets the others' fingerprint
    owner = list(w)
    for at in range(10, 200, 25):
        owner[at] = f"other{at}"
    texts = {1: filler + " ".join(owner), 2: filler + " ".join([*w[:-1], "end"]), 3: third}
    assert h.simhash(texts[1]) == h.simhash(texts[2]) != h.simhash(third) and h.jaccard(texts[1], third) < 0.8 <= h.jaccard(texts[2], third)
    rest = {i: " ".join(f"x{i}y{k}" for k in range(50)) for i in range(4, 8)}
    out = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame([*texts.items(), *rest.items()], "doc_id long, text string"), sf_dir)
    assert {r["doc_id"] for r in out.collect()} == {1, *rest}


def test_a_copy_does_not_take_its_doc_ids_other_text_along(spark, sf_dir):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (3, b + " other"), (None, "c d e f g h i j")]
    out = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted([(0, "c d e f g h i j"), (1, a), (2, b)])


def test_a_run_stays_readable_when_others_follow(spark, sf_dir):
    first = corpus_pipeline.run(spark, sf_dir)
    n = first.count()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    near = corpus_pipeline.STAGES[1][1](spark, docs, sf_dir)
    corpus_pipeline.STAGES[2][1](spark, near, sf_dir).count()
    assert first.count() == n and near.count() > 0


def test_columns_of_any_name_travel_through_all_stages(spark, sf_dir):
    names = ["gone", "n_removed", "n_words", "row", "rest", "d", "h", "sum", "doc", "component", "kept", "hits", "items", "start", "starts", "ns", "packed", "lettered", "length", "part", "a.b"]
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    rows = [(1, text, *names), (2, text, *names), (3, "other words that stay", *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert all(list(r)[2:] == names for r in docs.collect()), name
    assert {r["doc_id"] for r in docs.collect()} == {1, 3}
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.collect()} == {1, 3}

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from lorebook.operators import gate as G
from lorebook.operators import retrieval as R
from lorebook.operators import similarity as S
from lorebook.plans import tables as T


def index(spark, docs, status=None):
    """docs: {id: (text, kind, origin, ecosystem)}"""
    rows = [(i, *v) for i, v in docs.items()]
    df = spark.createDataFrame(rows, "record_id string, body string, kind string, origin string, ecosystem string")
    records = df.select("record_id", "kind", F.lit("validated").alias("status"), F.lit("t").alias("title"), F.lit("").alias("summary"), F.lit("p").alias("path"), "origin")
    fps = df.select(R.X.generic_fingerprint("body").alias("fp"), F.lit("generic").alias("scope"), "record_id")
    applies = df.select("record_id", "ecosystem", F.lit("pkg").alias("package"))
    return R.CorpusIndex(records, fps, applies, R.token_index(df, ["body"]))


def test_phrases_match_consecutive_terms_only(spark):
    docs = spark.createDataFrame([("a", "use modernc.org/sqlite and modernc org sqlite"), ("b", "sqlite org modernc"), ("c", "x x x")], "record_id string, body string")
    tokens = R.token_index(docs, ["body"])
    phrases = spark.createDataFrame([("modernc org sqlite",), ("sqlite",), ("x x",), ("nothing here",)], "phrase string")
    got = {(r["phrase"], r["record_id"]): r["tf"] for r in R.phrase_hits(tokens, phrases).collect()}
    assert got == {("modernc org sqlite", "a"): 2, ("sqlite", "a"): 2, ("sqlite", "b"): 1, ("x x", "c"): 2}


def test_bm25_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    docs = {f"d{i:02d}": [rng.choice(vocab[: 5 + i]) for _ in range(rng.randint(3, 40))] for i in range(25)}
    queries = {f"q{i}": [rng.choice(vocab) for _ in range(6)] for i in range(8)}
    tokens = R.token_index(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "record_id string, body string"), ["body"])
    q = spark.createDataFrame([(k, " ".join(v)) for k, v in queries.items()], "query_id string, text string")
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    want = {}
    for qid, terms in queries.items():
        scores = {}
        for d, words in docs.items():
            s = 0.0
            for t in terms:
                df = sum(t in w for w in docs.values())
                tf = words.count(t)
                if tf:
                    idf = math.log((n - df + 0.5) / (df + 0.5))
                    s += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
            if s:
                scores[d] = round(s, 9)
        want[qid] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:3]
    for ranked in (R.bm25_topk(q, tokens, 3, -1.0), R.top_ranked(R.bm25_scores(q, tokens), 3)):
        got = {}
        for r in ranked.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["record_id"], r["score"]))
        for qid in want:
            assert [i for i, _ in got.get(qid, [])] == [i for i, _ in want[qid]]
            assert all(abs(a - b) < 1e-6 for (_, a), (_, b) in zip(got.get(qid, []), want[qid]))


def test_pruning_changes_nothing_on_documents(spark, sf):
    q = T.corpus(spark, sf).select(F.col("id").alias("query_id"), F.col("body").alias("text"))
    tokens = T.document_tokens(spark, sf)
    plain = {tuple(r) for r in R.bm25_topk(q, tokens, 3).collect()}
    assert plain == {tuple(r) for r in R.top_ranked(R.apply_floor(R.bm25_scores(q, tokens), None), 3).collect()}


def test_repeated_tokens_weigh_twice_and_a_limit_is_a_choice(spark):
    q = spark.createDataFrame([("q", "a a b " + " ".join(f"t{i}" for i in range(30)))], "query_id string, text string")
    got = {r["phrase"]: r["qtf"] for r in R.query_phrases(q).collect()}
    assert got["a"] == 2 and sum(got.values()) == 33 and "t29" in got
    got = {r["phrase"]: r["qtf"] for r in R.query_phrases(q, max_tokens=24).collect()}
    assert got["a"] == 2 and sum(got.values()) == 24 and "t20" in got and "t21" not in got


def test_rrf_scores_and_order_independence(spark):
    a = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "query_id string, rank int, record_id string")
    b = spark.createDataFrame([("q", 1, "y"), ("q", 2, "z")], "query_id string, rank int, record_id string")
    fused = {r["record_id"]: (r["rank"], r["score"]) for r in R.rrf_fuse(a, b).collect()}
    assert fused["x"] == (2, round(1 / 61, 12)) and fused["y"][0] == 1
    swapped = {r["record_id"]: (r["rank"], r["score"]) for r in R.rrf_fuse(b, a).collect()}
    assert fused == swapped


def test_dense_paths_agree_with_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(60, 8))
    vecs[7] = 0
    rows = [(f"v{i:02d}", [float(x) for x in v]) for i, v in enumerate(vecs)] + [("short", [1.0, 2.0])]
    corpus = spark.createDataFrame(rows, "record_id string, vec array<float>")
    queries = spark.createDataFrame(rows[:20], "query_id string, vec array<float>")
    f32 = vecs.astype("float32").astype("float64")
    want = set()
    for i in range(20):
        norms = np.linalg.norm(f32, axis=1) * np.linalg.norm(f32[i])
        sims = np.round(np.divide(f32 @ f32[i], norms, out=np.zeros(60), where=norms > 0), 9)
        best = sorted((-s, f"v{j:02d}") for j, s in enumerate(sims) if s >= 0.3)[:4]
        want |= {(f"v{i:02d}", n, r) for n, (_, r) in enumerate(best, 1)}
    whole = {tuple(r)[:3] for r in R.dense_match(queries, corpus, 0.3, 4).collect()}
    parted = {tuple(r)[:3] for r in R.dense_match(queries, corpus, 0.3, 4, cell=6).collect()}
    assert whole == want == parted


def test_fingerprint_match_keeps_lowest_ids_of_a_hot_group(spark):
    fps = spark.range(500).select(R.X.generic_fingerprint(F.lit("boom 42")).alias("fp"), F.format_string("r%04d", "id").alias("record_id"))
    q = spark.createDataFrame([("q1", "Boom  7"), ("q2", "other"), ("q3", " ")], "query_id string, text string")
    got = [(r["query_id"], r["rank"], r["record_id"]) for r in R.fingerprint_match(q, fps).orderBy("rank").collect()]
    assert got == [("q1", 1, "r0000"), ("q1", 2, "r0001"), ("q1", 3, "r0002")]


def test_push_gate_paths(spark):
    filler = {f"f{i}": ("common words everywhere", "trap", "me", "go") for i in range(40)}
    docs = {
        "a1": ("servemux tmpdir common", "trap", "me", "go"),
        "a2": ("servemux alone common", "trap", "me", "go"),
        "a3": ("quuxify importonly", "trap", "importer", "go"),
        "a4": ("conventiononly bm25", "convention", "me", "docker"),
        **filler,
    }
    idx = index(spark, docs)
    q = spark.createDataFrame(
        [
            ("both", "why does servemux need tmpdir", False), ("one", "servemux question", False), ("err", "servemux question", True),
            ("none", "common words", False), ("import", "quuxify importonly please", False), ("conv", "conventiononly bm25", False),
            ("exact", "conventiononly BM25", False),
        ],
        "query_id string, text string, error_trigger boolean",
    )
    idf = spark.createDataFrame([("question", 90), ("need", 80)], "word string, df bigint")
    stop = spark.createDataFrame([("why",), ("does",)], "word string")
    out = {r["query_id"]: r for r in G.push_gate(q, idx, idf, 100, stop, ["importer"], floor=0.5).collect()}
    assert out["both"]["path"] == "retrieved" and [h["record_id"] for h in out["both"]["served"]] == ["a1"]
    assert out["one"]["path"] == "single" and out["one"]["count"] == 0
    assert out["err"]["path"] == "retrieved" and {h["record_id"] for h in out["err"]["served"]} == {"a1", "a2"}
    assert out["none"]["path"] == out["import"]["path"] == "closed"
    # The exact bypass serves what the gate itself would not.
    assert out["exact"]["path"] == out["conv"]["path"] == "fingerprint" and out["exact"]["served"][0]["record_id"] == "a4"


def test_containment_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 30))) for _ in range(30)]
    texts += [texts[0]] * 10
    drafts = spark.createDataFrame(list(enumerate(texts)), "draft_id int, text string")
    refs = spark.createDataFrame(list(enumerate(texts[:8])), "ref_id int, text string")

    def grams(t):
        w = t.split()
        return {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}

    want = {}
    for i, d in enumerate(texts):
        for j, r in enumerate(texts[:8]):
            both = grams(d) & grams(r)
            if both:
                want[(i, j)] = (len(both), sorted(both), len(both) / len(grams(d)))
    for threshold in (0.15, 0.5, 0.8, 1.0):
        got = {(r["draft_id"], r["ref_id"]): (r["shared"], r["matches"], r["containment"]) for r in S.containment_join(drafts, refs, 2, threshold, True).collect()}
        assert got == {k: v for k, v in want.items() if v[2] >= threshold}


def test_containment_with_a_passage_in_a_third_of_both_sides(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    own = lambda side, i: " ".join(f"{side}{i}x{k}" for k in range(120))
    text = lambda side, i: f"{own(side, i)} {passage}" if i % 3 == 0 else own(side, i)
    drafts = [(i, text("d", i)) for i in range(300)] + [(900, own("r", 4))]
    refs = [(i, text("r", i)) for i in range(300)]
    got = S.containment_join(spark.createDataFrame(drafts, "draft_id int, text string"), spark.createDataFrame(refs, "ref_id int, text string")).collect()
    assert [(r.draft_id, r.ref_id, r.containment) for r in got] == [(900, 4, 1.0)]


def test_containment_stores_shared_shingles_only(spark, monkeypatch):
    few = [(0, "a b c d e f"), (1, "x y z")]
    many = [(i, f"w{i} a b c d v{i} " + " ".join(f"u{i}x{j}" for j in range(50))) for i in range(200)]
    stored, store = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: stored.append(store(df)) or stored[-1])
    frame = lambda rows, i: spark.createDataFrame(rows, f"{i} int, text string")
    got = S.containment_join(frame(few, "draft_id"), frame(many, "ref_id"), 3, 0.4).collect()
    assert sorted((r.draft_id, r.ref_id, r.shared, r.total) for r in got) == [(0, i, 2, 4) for i in range(200)]
    back = S.containment_join(frame(many, "draft_id"), frame(few, "ref_id"), 3, 2 / 54).collect()
    assert sorted((r.draft_id, r.ref_id, r.shared, r.total) for r in back) == [(i, 0, 2, 54) for i in range(200)]
    # Of 10,800 shingles of the larger side only those of the smaller one are kept.
    assert max(t.count() for t in stored) <= 400


def test_the_last_word_of_a_long_query_counts(spark):
    docs = [("a", "needle"), *[(f"d{i}", f"hay{i} straw") for i in range(40)]]
    tokens = R.token_index(spark.createDataFrame(docs, "record_id string, body string"), ["body"])
    text = " ".join(f"word{i}" for i in range(1999)) + " needle"
    q = spark.createDataFrame([("q", text)], "query_id string, text string")
    assert [r.record_id for r in R.bm25_topk(q, tokens, 3).collect()] == ["a"]
    assert R.bm25_topk(q, tokens, 3, max_tokens=24).count() == 0
    assert [r.phrase for r in R.doc_freq(tokens, R.query_phrases(q)).collect()] == ["needle"]
    assert [tuple(r)[:4] for r in R.lexical_match(q, tokens).collect()] == [("q", 1, "a", 1)]


def test_wide_vectors_and_ties(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 1536))
    x[20:40] = x[0]
    corpus = spark.createDataFrame([(f"r{i:02d}", v.tolist()) for i, v in enumerate(x)], "record_id string, vec array<float>").repartition(3)
    queries = spark.createDataFrame([("q0", x[0].tolist()), ("q1", x[50].tolist()), ("q2", [1.0, 2.0])], "query_id string, vec array<float>")
    for cell in (1024, 3):
        got = [(r.query_id, r["rank"], r.record_id) for r in R.dense_match(queries, corpus, 0.5, 4, cell=cell).orderBy("query_id", "rank").collect()]
        assert got == [("q0", 1, "r00"), ("q0", 2, "r20"), ("q0", 3, "r21"), ("q0", 4, "r22"), ("q1", 1, "r50")]


def test_novelty(spark):
    idx = index(spark, {"a": ("alpha beta gamma", "trap", "me", "go"), "b": ("delta", "trap", "me", "go"), "c": ("zeta eta", "trap", "me", "go")})
    q = spark.createDataFrame([("k", "Alpha beta  gamma"), ("s", "gamma only"), ("n", "unseen words")], "query_id string, text string")
    got = {r["query_id"]: r["novelty"] for r in R.assess_novelty(q, idx).collect()}
    assert got == {"k": "known", "s": "similar", "n": "novel"}


def test_document_frequencies_read_served_records_once(spark, monkeypatch):
    docs = [("a", "red fox"), ("b", "red hen"), ("c", "red fox den"), ("d", "hen")]
    tokens = R.token_index(spark.createDataFrame(docs, "record_id string, body string"), ["body"])
    phrases = spark.createDataFrame([("red",), ("fox",), ("hen",), ("red fox",), ("den",)], "phrase string")
    ids = lambda *r: spark.createDataFrame([(x,) for x in r], "record_id string")
    read, hits = [], R.phrase_hits
    monkeypatch.setattr(R, "phrase_hits", lambda t, p, carry=(), among=None: read.append(among) or hits(t, p, carry, among))
    got = {tuple(r) for r in R.doc_freqs(tokens, phrases, x=ids("a", "b", "d", "d"), y=ids("b")).collect()}
    assert got == {("red", 2, 1), ("fox", 1, 0), ("hen", 2, 1), ("red fox", 1, 0)}
    assert {tuple(r) for r in R.doc_freq(tokens, phrases, ids("c", "c")).collect()} == {("red", 1), ("fox", 1), ("red fox", 1), ("den", 1)}
    assert [sorted(r.record_id for r in among.collect()) for among in read] == [["a", "b", "d"], ["c"]]


def test_rankings_read_twice_are_scored_once(spark, capsys):
    idx = index(spark, {f"d{i}": (f"alpha beta w{i}", "trap", "me", "go") for i in range(9)})
    idx.vectors = spark.createDataFrame([("d1", [1.0, 0.0])], "record_id string, vec array<float>")
    queries = spark.createDataFrame([("q", "w1 w2", [1.0, 0.0], False), ("p", "w3", None, True)], "query_id string, text string, vec array<float>, error_trigger boolean")
    R.retrieve_fused(queries.drop("error_trigger"), idx).explain()
    none = spark.createDataFrame([], "word string, df bigint")
    G.push_gate(queries.drop("vec"), idx, none, 100, none, floor=0.5).explain()
    assert "FlatMapCoGroupsInArrow" not in capsys.readouterr().out


def test_guard_shuffles_texts_and_no_shingles(spark, sf):
    from lorebook.plans import content

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = content.leak_and_relevance_guard(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Exchange hashpartitioning(record_id" in plan and "sequence(" not in plan.split("Exchange hashpartitioning(record_id", 1)[1]


def test_guard_of_odd_tasks(spark):
    from pyspark.sql import functions as F

    from lorebook.operators import similarity as S
    from lorebook.operators.ingest import typed

    frame = lambda fixes, schema: spark.createDataFrame(fixes, schema)
    texts = frame([("r", "broken Widget", "a b c. A b C d"), ("s", "it is 2024", None)], "id string, title string, fix string")
    records = typed(
        texts.select(
            "id", "title",
            F.struct(F.lit(None).cast("string").alias("root_cause"), "fix", F.lit(None).cast("array<struct<tried:string,why_it_failed:string>>").alias("dead_ends")).alias("resolution"),
        )
    )
    tasks = [("leak", "r", "x a B c a, b c"), ("short", "r", "a b"), ("none", "r", None), ("empty", "r", ""), ("near", "r", "the widget"), ("any", "s", "what"), ("lost", "t", "a")]
    got = S.leak_and_relevance_guard(frame(tasks, "task_id string, record_id string, prompt string"), records, 3, 0.5).collect()
    assert {r.task_id: (r.record_id, r.containment, r.verdict) for r in got} == {
        "leak": ("r", 0.75, "leak"), "short": ("r", 0.0, "irrelevant"), "none": ("r", 0.0, "ok"), "empty": ("r", 0.0, "irrelevant"),
        "near": ("r", 0.0, "ok"), "any": ("s", 0.0, "ok"),
    }


def test_ngrams_of_a_long_text_copy_no_slices(spark):
    from pyspark.sql import functions as F

    from lorebook.functions import text as X

    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a", "b"],), ([],), (None,)], "w array<string>").select(X.ngrams(F.col("w"), 3).alias("g"))
    assert [r.g for r in df.collect()] == [["a b c", "b c d"], [], [], []]
    assert "slice(" not in df._jdf.queryExecution().optimizedPlan().toString()

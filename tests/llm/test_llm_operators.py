"""The corpus operators against brute force, round trips and held-out accuracy, with nulls, empties, ties and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, components, fingerprint, langid, lm, mixing, packing, probminhash, queries, spherical, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs(spark, texts, **more):
    rows = [(k, t, more.get("lang"), more.get("source"), None, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def connected(pairs, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- packing -----------------------------------------------------------------------------------------------------------


def test_packing_places_every_id_once(spark, data):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer())
    given = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "tie"), (9003, "tie"), (None, "x"), (9004, "İ Σ <|endoftext|> é 　 'S '' don't. " * 9), (9005, "word " * 30000)], "doc_id long, text string")
    every = given.unionByName(odd).withColumn("offset", F.lit("clash")).repartition(5).persist()
    texts = {r.doc_id: r.text or "" for r in every.collect()}
    placed = packing.pack(every, queries.tokenizer(), size=256, windows=3).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in placed:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = [*own.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        times = 2 if doc_id == 9003 else 1
        got = sorted((p.start, np.frombuffer(p.ids, "<u4").tolist()) for p in pieces)
        assert sum(p.length for p in pieces) == times * len(ids) and {p.doc_tokens for p in pieces} == {len(ids)}
        if times == 1:
            assert [x for _, part in got for x in part] == ids and all(p.length == len(p.ids) // 4 for p in pieces)
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        lengths.append(at)
    assert all(n == 256 or n & (n - 1) == 0 for n in lengths) and sum(n < 256 for n in lengths) <= 8
    assert packing.pack(every.limit(0), queries.tokenizer()).count() == 0


# --- embeddings -----------------------------------------------------------------------------------------------------------


def planted_vectors(seed=3, n=1500, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, 600, 3):  # around the threshold of 0.9
        noise = rng.normal(size=dim)
        noise -= noise @ x[k] / (x[k] @ x[k]) * x[k]
        c = 0.88 + 0.1 * rng.random()
        x[k + 1] = c * x[k] / np.linalg.norm(x[k]) + math.sqrt(1 - c * c) * noise / np.linalg.norm(noise)
    x[900:1000] = x[899] * rng.uniform(0.5, 2, (100, 1)) + 0.05 * rng.normal(size=(100, dim))
    x[1100:1120] = x[1099]
    return x


def test_vectors_against_brute_force(spark):
    x = planted_vectors()
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [1.0, None], 1), (2004, [], 1)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int").repartition(4)
    got = {r.vec_id: r for r in spherical.near_vectors(given).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    assert sum(got[k].n_links for k in range(len(x))) >= 0.99 * links.sum()
    assert all(got[k].n_links <= links[k] for k in range(len(x)))
    want = connected(np.argwhere(near), range(len(x)))
    assert np.mean([got[k].component_id == want[k] for k in range(len(x))]) > 0.98
    assert all(got[k].n_links == 0 and got[k].kept for k in range(2000, 2005))
    assert spherical.near_vectors(given.limit(0)).count() == 0


def test_vector_blocks_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(spherical, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=16) + 0.02 * rng.normal(size=(120, 16))
    got = spherical.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}


@pytest.mark.parametrize(("dim", "rows"), [(64, 50_000), (64, 3_000_000), (32, 3_000_000), (2, 1000)])
def test_vector_recall_at_any_size(dim, rows):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    plan = spherical.Plan.make(dim, per_filter=24, hits=8, rows=rows)
    codes = spherical.Codes.make(plan)
    (a, f), (b, g) = codes.decode(x), codes.decode(y)
    assert len(a) >= 0.9 * 8 * plan.rotations * len(x)
    one, two = [set(f[a == k]) for k in range(len(x))], [set(g[b == k]) for k in range(len(x))]
    assert np.mean([bool(p & q) for p, q in zip(one, two, strict=True)]) >= 0.98


def test_cap_share_is_exact():
    assert spherical.cap_share(3, 0.5) == pytest.approx(0.25, rel=1e-6)  # on the sphere, heights are uniform
    assert spherical.cap_share(2, 0.5) == pytest.approx(1 / 3, rel=1e-6)


# --- language and toxicity ----------------------------------------------------------------------------------------------


def test_language_held_out(spark, data):
    given = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(given, ~held)
    told = langid.identify(given.where(held).withColumn("score", F.lit("clash")), model)
    assert told.where("lang_pred = lang").count() >= 0.97 * told.count()
    assert told.where("not (score >= 0 and score <= 1)").count() == 0
    assert told.where("rejected").count() <= 0.03 * told.count()
    odd = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.identify(docs(spark, [None, "", "12 -- 3", "a " * 100_000]), model).collect()}
    assert [odd[k] for k in range(3)] == [("und", True)] * 3 and odd[3][0] in model.labels
    none = langid.train(given.limit(0), F.lit(True))
    assert langid.identify(docs(spark, ["hello"]), none).first().lang_pred == "und"


def test_toxicity_held_out(spark, data):
    base = data.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    given = spark.read.parquet(f"{base}/documents.parquet").join(labels, "doc_id")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.train(given.drop("toxic", "quality"), labels.where(~held))
    told = toxicity.score(given.where(held), model).groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in told}
    assert n.get((1, 1), 0) >= 0.75 * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[(0, 0)]
    odd = toxicity.score(docs(spark, [None, "", "x" * 100_000]), model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(0)
    word = {w: toxicity.text_terms(w) for w in ("grubs", "folkx", *(f"noise{k}" for k in range(40)))}
    samples = []
    for _ in range(1500):
        has = [w for w in ("grubs", "folkx") if rng.random() < 0.4] + [f"noise{k}" for k in rng.integers(0, 40, 6)]
        samples.append((int("grubs" in has and "folkx" in has), np.unique(np.concatenate([word[w] for w in has])).astype(np.int64), 1.0))
    model = toxicity.fit(samples, epochs=40)
    assert model.score("grubs folkx") > 0.7 and max(model.score("grubs"), model.score("folkx"), model.score("noise1")) < 0.5
    assert toxicity.fit([]).score("x") == 0.5


def test_toxicity_learns_pairs_without_single_effects():
    rng = np.random.default_rng(1)
    word = {w: toxicity.text_terms(w) for w in ("grubs", "folkx", *(f"{chr(97 + k)}noise" for k in range(26)))}
    samples = []
    for _ in range(2000):
        has = [w for w in ("grubs", "folkx") if rng.random() < 0.5]
        label = int(len(has) != 1)
        has += [f"{chr(97 + k)}noise" for k in rng.integers(0, 26, 5)]
        samples.append((label, np.unique(np.concatenate([word[w] for w in has])).astype(np.int64), 1.0))
    model = toxicity.fit(samples, epochs=40)
    assert min(model.score("grubs folkx"), model.score("anoise bnoise")) > 0.7 and max(model.score("grubs anoise"), model.score("folkx bnoise")) < 0.3


def test_toxicity_odds_against_all_pairs():
    rng = np.random.default_rng(2)
    text = "some words to be weighed in pairs"
    kept = np.sort(rng.choice(toxicity.text_terms(text), 9, replace=False))
    model = toxicity.Model(kept, 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    want = 0.3 + model.weights.sum() + sum(model.factors[i] @ model.factors[j] for i in range(9) for j in range(i))
    assert model.score(text) == pytest.approx(1 / (1 + np.exp(-want)))


def test_language_score_against_single_subwords():
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(1 << langid.BITS, 3)).astype(np.float32), rng.normal(size=3), 0.7, 0.5)
    text = "Überall, wo WORTE stehen -- 12 mal"
    padded, found = b" " + bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()) + b" ", []
    for n, times, plus in ((3, 2654435761, 0), (4, 2246822519, 97)):
        for k in range(len(padded) - n + 1):
            part = padded[k : k + n]
            if 32 not in part[1:-1]:
                found.append(((int.from_bytes(part, "little") * times + plus) % 2**32) >> (32 - langid.BITS))
    z = sum(model.table[x].astype(float) for x in found) / len(found) + model.bias
    p = np.exp(z / 0.7) / np.exp(z / 0.7).sum()
    assert model.predict(text) == (model.labels[int(p.argmax())], pytest.approx(p.max()), p.max() < 0.5)
    tied = langid.Model(["a", "b"], np.zeros((1 << langid.BITS, 2), np.float32), np.zeros(2))
    assert tied.predict("words") == ("a", 0.5, False)


CLASH = "doc_id long, TEXT string, SCORE string, Lang_Pred int, Predicted int, whole string, c0 string, _whole string, N_Tokens string, lang string, Rejected string"


@pytest.mark.parametrize("rows", [0, 3])
def test_scorers_replace_columns_whatever_their_case(spark, data, rows):
    given = [(k, t, "s", 1, 2, "w", "c", "x", "n", "en", "r") for k, t in ((1, "the same words"), (1, "the same words"), (None, None))][:rows]
    frame = spark.createDataFrame(given, CLASH)
    sample = spark.createDataFrame([(k, f"{w} words", lang) for k in range(20) for w, lang in (("the", "en"), ("les", "fr"))], "doc_id long, text string, lang string")
    told = [
        (langid.identify(frame, langid.train(sample, F.lit(True)), "text"), ("lang_pred", "score", "rejected")),
        (toxicity.score(frame, toxicity.train(sample, spark.createDataFrame([], "doc_id long, toxic int")), text="text"), ("score", "predicted")),
        (lm.score(frame, lm.train(sample, F.lit(True)), "text"), ("n_tokens", "n_known", "base_score", "score")),
    ]
    for out, new in told:
        assert [c for c in out.columns if c in new] == list(new) and len({c.lower() for c in out.columns}) == len(out.columns)
        got = out.collect()
        assert len(got) == rows and {"whole", "_whole", "c0", "TEXT"} <= set(out.columns)
        assert not rows or got[0] == got[1]


# --- near-duplicates -------------------------------------------------------------------------------------------------------


def near_texts(seed=5):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefg"), 5))
    out = []
    for _ in range(60):
        base = [word() for _ in range(120)]
        out.append(" ".join(base))
        for _ in range(rng.integers(0, 4)):
            edit = list(base)
            for k in rng.integers(0, 120, rng.integers(1, 6)):
                edit[k] = word()
            out.append(" ".join(edit))
    shared = [word() for _ in range(80)]
    out += [" ".join(shared + [word() for _ in range(60)]) for _ in range(30)]
    return [*out, out[0], out[0].upper(), None, "", "", "two words", "two words", "x y z", " ".join(["again and again"] * 500)]


def brute_links(texts):
    sets = [probminhash.shingles(t or "") for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i][0]) and len(sets[j][0]) and probminhash.similarity(sets[i], sets[j]) >= 0.8]


def test_near_duplicates_against_brute_force(spark):
    texts = near_texts()
    classes, links = probminhash.near_duplicates(docs(spark, texts).repartition(3))
    got = {r.doc_id: r for r in classes.collect()}
    same = [(i, j) for i in range(len(texts)) for j in range(i) if (texts[i] or "") == (texts[j] or "")]
    want = connected(brute_links(texts) + same, range(len(texts)))
    assert {k: r.class_id for k, r in got.items()} == want
    assert {k for k, r in got.items() if r.kept} == set(want.values())
    assert all(r.similarity >= 0.8 for r in links.collect())
    empty, _ = probminhash.near_duplicates(docs(spark, []))
    assert empty.count() == 0


def test_classes_that_only_chains_connect(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "FAN", 4)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[k : k + 150]) for k in range(0, 200, 8)]  # neighbours overlap by 0.9, distant ones hardly
    classes, _ = probminhash.near_duplicates(docs(spark, texts))
    assert {r.class_id for r in classes.collect()} == {0}


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    sets = [(np.unique(rng.integers(0, 90, 60).astype(np.uint64)), None) for _ in range(8)]
    sets = [(k, rng.integers(1, 6, len(k)).astype(float)) for k, _ in sets]
    signed = probminhash.signatures(sets, 3000)

    def brute(a, b):
        x, y = dict(zip(a[0].tolist(), a[1])), dict(zip(b[0].tolist(), b[1]))
        return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in set(x) | set(y)) for d in set(x) & set(y))

    for k in range(1, 8):
        assert probminhash.similarity(sets[0], sets[k]) == pytest.approx(brute(sets[0], sets[k]))
        assert (signed[0] == signed[k]).mean() == pytest.approx(brute(sets[0], sets[k]), abs=0.05)
    fast = probminhash.Sets(sets[1:]).similarities(sets[0])
    assert fast == pytest.approx([brute(sets[0], s) for s in sets[1:]])


@pytest.mark.parametrize("how", [components.connected_components, components.components_of_ids])
def test_components(spark, how):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7)]
    edges = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    want = connected(pairs, {x for p in pairs for x in p})
    assert {r.node: r.component for r in how(edges).collect()} == want
    assert how(edges.limit(0)).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    texts = ["Ａ  b\n", "a b", None, "", "ﬁn STRASSE", "fin straße", "other", "other"]
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs(spark, texts)).collect()}
    assert [got[k].group_id for k in range(8)] == [0, 0, 2, 2, 4, 4, 6, 6] and got[0].copies == 2
    bad = fingerprint.fingerprints(docs(spark, texts), check=lambda folded: str(len(folded))).collect()
    assert sorted((r.doc_id, r.group_id) for r in bad) == [(k, k // 2 * 2) for k in range(8)]


def test_edit_sensitivity(spark):
    texts = ["abcdef", "ABCxyz", "", None, "0123456789", "é" * 7, "abcdef"]
    got = {r.doc_id: r for r in fingerprint.edit_sensitivity(docs(spark, texts).repartition(4)).collect()}
    for k, text in enumerate(texts):
        text, after = text or "", texts[(k + 1) % len(texts)] or ""
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[k].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[k].n_chars == len(text)
        assert (got[k].near_edited, got[k].near_next) == (float(changed.lower() == text.lower()), float(text.lower() == after.lower()))
    assert got[0].fingerprint == got[6].fingerprint != got[1].fingerprint
    assert fingerprint.edit_sensitivity(docs(spark, [])).count() == 0
    assert fingerprint.edit_sensitivity(docs(spark, ["lone"])).first().near_next == 1.0


# --- mixing ------------------------------------------------------------------------------------------------------------------


def fill(given, caps, weights):
    """Budgets by giving in rounds, each in proportion to the weights of those that are not full."""
    out = [0.0] * len(caps)
    while given > 1e-9:
        open_ = [k for k in range(len(caps)) if weights[k] > 0 and out[k] < caps[k] - 1e-9]
        if not open_:
            break
        step = min([given / sum(weights[k] for k in open_)] + [(caps[k] - out[k]) / weights[k] for k in open_])
        for k in open_:
            out[k] += step * weights[k]
        given -= step * sum(weights[k] for k in open_)
    return out


def test_budgets_against_rounds(spark):
    rng = np.random.default_rng(6)
    leaves = [(f"d{d}", f"l{a}", f"s{s}", int(rng.integers(1, 500))) for d in range(3) for a in range(3) for s in range(4)]
    weights = {"d0": 0.6, "d1": 0.3, "d2": 0.1}
    table = spark.createDataFrame(list(weights.items()), "domain string, weight double")
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(frame, F.lit(0.7) * F.col("tokens"), 1, (table, None, None)).collect()}
    total = 0.7 * sum(x[3] for x in leaves)
    by_domain = fill(total, [sum(x[3] for x in leaves if x[0] == d) for d in weights], list(weights.values()))
    for d, given in zip(weights, by_domain, strict=True):
        langs = sorted({x[1] for x in leaves if x[0] == d})
        for a, part in zip(langs, fill(given, [sum(x[3] for x in leaves if x[:2] == (d, k)) for k in langs], [1] * len(langs)), strict=True):
            own = [x for x in leaves if x[:2] == (d, a)]
            for x, b in zip(own, fill(part, [y[3] for y in own], [1] * len(own)), strict=True):
                assert got[x[:3]] == pytest.approx(b, abs=1e-6)
    assert sum(got.values()) == pytest.approx(total)


@pytest.mark.parametrize("name", ["op2_embedding_near_dedup", "op7_mixing", "op9_url_filters"])
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want


def test_mixing_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, "a b", None, None), (2, "a b", None, None), (3, "", "en", "s")], "doc_id long, text string, lang string, source string")
    got = mixing.mix(rows, queries.n_words(), queries.domain(), epochs=3, fraction=9.0).collect()
    assert Counter((r.doc_id, r.epoch) for r in got) == {(2, k): 2 for k in range(3)}
    assert mixing.mix(rows.limit(0), queries.n_words(), queries.domain()).count() == 0


def test_budget_of_closed_leaves_goes_to_other_domains(spark):
    leaves = spark.createDataFrame([("d0", "en", "s", 100), ("d0", "xx", "s", 900), ("d1", "en", "s", 1000)], "domain string, lang string, source string, tokens long")
    by_lang = spark.createDataFrame([("d0", "en", 1.0), ("d1", "en", 1.0)], "domain string, lang string, weight double")
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, F.lit(0.5) * F.col("tokens"), 1, (None, by_lang, None)).collect()}
    assert got == {("d0", "en"): 100, ("d0", "xx"): 0, ("d1", "en"): 900}


def rounds(node, given):
    """Token by token down a tree {name: (weight, subtree or tokens)}: each goes to the child that has least of its weight and still can take one."""
    out = {}

    def room(sub):
        return sub if isinstance(sub, int) else sum(room(x) for w, x in sub.values() if w > 0)

    def give(sub, path, n):
        if isinstance(sub, int):
            out[path] = n
            return
        took = dict.fromkeys(sub, 0)
        for _ in range(n):
            ready = [k for k, (w, x) in sub.items() if w > 0 and took[k] < room(x)]
            took[min(ready, key=lambda k: ((took[k] + 1) / sub[k][0], k))] += 1
        for k, (_, x) in sub.items():
            give(x, (*path, k), took[k])

    give(node, (), min(given, room(node)))
    return out


def test_budgets_against_rounds_with_closed_nodes(spark):
    tree = {
        "a": (0.5, {"x": (0.0, {"s": (1.0, 1000)}), "y": (1.0, {"s": (1.0, 10)})}),
        "b": (0.5, {"x": (1.0, {"s": (1.0, 700), "t": (1.0, 100)}), "(none)": (2.0, {"(none)": (1.0, 300)})}),
        "c": (0.0, {"x": (1.0, {"s": (1.0, 50)})}),
    }
    leaves = [(d, k, s, n) for d, (_, langs) in tree.items() for k, (_, sources) in langs.items() for s, (_, n) in sources.items()]
    by_domain = spark.createDataFrame([(d, w) for d, (w, _) in tree.items()], "domain string, weight double")
    by_lang = spark.createDataFrame([(d, k, w) for d, (_, langs) in tree.items() for k, (w, _) in langs.items()], "domain string, lang string, weight double")
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for total in (1005, 300, 5000):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(frame, F.lit(float(total)), 1, (by_domain, by_lang, None)).collect()}
        want = rounds(tree, total)
        assert sum(got.values()) == pytest.approx(min(total, 1110))
        assert all(abs(got[k] - want[k]) <= 3 for k in want), (got, want)


def test_unlisted_languages_have_a_share(spark):
    leaves = spark.createDataFrame([("d", "en", "s", 1000), ("d", "xx", "s", 1000), ("d", "yy", "s", 1000)], "domain string, lang string, source string, tokens long")
    by_lang = spark.createDataFrame([("d", "en", 0.6), ("d", None, 0.4)], "domain string, lang string, weight double")
    got = {r.lang: r.budget for r in mixing.budgets(leaves, F.lit(1000.0), 1, (None, by_lang, None)).collect()}
    assert got == pytest.approx({"en": 600, "xx": 200, "yy": 200})
    rows = spark.createDataFrame([(k, "a b c", lang, "src1") for k, lang in enumerate(["en", None, "it"])], "doc_id long, text string, lang string, source string")
    chosen = mixing.mix(rows, queries.n_words(), queries.domain(), epochs=1, weights=queries.mix_weights(spark)).collect()
    assert sorted(r.doc_id for r in chosen) == [0, 1, 2]


def test_language_stage_names_the_language(spark, data):
    import corpus_pipeline

    given = spark.read.parquet(data + "/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    told = corpus_pipeline.language(spark, given, data)
    assert told.columns == given.columns and told.where("doc_id % 5 = 0").count() > 20
    assert told.where("lang is null").count() == 0


# --- language model --------------------------------------------------------------------------------------------------------


def brute_model(texts, order):
    """(training counts, probability of (context, word)) of interpolated modified Kneser-Ney, written down level by level."""
    counts, grams = Counter(), Counter()
    for t in texts:
        words = [*t.encode().lower().split(), lm.END]
        counts.update(words)
        padded = [lm.END] * (order - 1) + words
        grams.update(tuple(padded[k : k + order]) for k in range(len(words)))
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    cuts, totals, rests = {}, defaultdict(int), defaultdict(float)
    for n, table in levels.items():
        times = Counter(table.values())
        cuts[n] = lm.discounts([times[k] for k in (1, 2, 3, 4)])
        for g, c in table.items():
            totals[n, g[:-1]] += c
            rests[n, g[:-1]] += cuts[n][min(c, 3) - 1]

    def p(context, word):
        n = len(context) + 1
        low = p(context[1:], word) if n > 1 else 1 / (len(counts) + 1)
        if not totals[n, context]:
            return low
        c = levels[n][(*context, word)]
        return ((c - cuts[n][min(c, 3) - 1] if c else 0) + rests[n, context] * low) / totals[n, context]

    return counts, p


@pytest.mark.parametrize(("order", "wide"), [(2, False), (3, False), (4, False), (3, True)])
def test_model_against_brute_force(spark, monkeypatch, order, wide):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"W{int(k)}" for k in rng.zipf(1.6, rng.integers(0, 40)) % 50) for _ in range(80)] + [None, "\x1cé é x\v y"]
    if wide:  # ids that don't fit together in 64 bits; whole texts above the size of a part, repeated rows
        texts += ["word " * 300_000] + ["said twice and the same"] * 2
        fits = lm.Keys.__init__
        monkeypatch.setattr(lm.Keys, "__init__", lambda self, v, n: fits(self, max(v, 1 << 30), n))
        coder = lm.Keys(9, 3)
        keys, n = coder.combine(coder.pack([np.array([2, 1, 2]), np.array([5, 1, 5]), np.array([0, 7, 0])]))
        assert coder.rows == 2 and n.tolist() == [1, 2] and [c.tolist() for c in coder.unpack(coder.from_bytes(coder.to_bytes(keys)))] == [[1, 2], [1, 5], [7, 0]]
    given = docs(spark, texts).repartition(3)
    model = lm.train(given, F.col("doc_id") % 4 != 0, order=order)
    counts, p = brute_model([(t or "") for k, t in enumerate(texts) if k % 4], order)
    assert (model.tokens, model.vocabulary) == (sum(counts.values()), len(counts))
    for r in lm.score(given, model).collect():
        words = [*(texts[r.doc_id] or "").encode().lower().split(), lm.END]
        assert r.n_tokens == len(words) and r.n_known == sum(counts[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (model.tokens + 0.5 * (len(counts) + 1))) for w in words))
        padded = [lm.END] * (order - 1) + words
        assert r.score == pytest.approx(sum(math.log10(p(tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(words)))
    known = tuple(list(counts)[: order - 1])
    assert sum(p(known, w) for w in counts) + p(known, b"new") == pytest.approx(1)
    none = lm.train(given, F.lit(False), order=order)
    assert lm.score(given, none).where("n_known > 0").count() == 0
    assert lm.score(given.limit(0), model).count() == 0


def test_frequent_context_words_are_divided():
    context, before = np.zeros(1000, np.uint64), np.arange(1000, dtype=np.uint64)
    apart = lm._shard(context, before, np.full(1000, 500), 1000, 16)
    assert len(set(apart.tolist())) > 4 and len(set(lm._shard(context, before, np.full(1000, 60), 1000, 16).tolist())) == 1
    hashed = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    kept = {}
    put, lm.put = lm.put, lambda folder, name, array: kept.__setitem__(name, array)
    try:
        order = lm.write_hashed("", "x", hashed)
    finally:
        lm.put = put
    at, hit = lm.find_hashed(kept["x-buckets"], kept["x-rest"], hashed)
    assert hit.all() and (hashed[order][at] == hashed).all()
    assert not lm.find_hashed(kept["x-buckets"], kept["x-rest"], hashed + np.uint64(1 << 40))[1].any()


# --- urls ---------------------------------------------------------------------------------------------------------------------


def test_rules_and_aliases(spark):
    page = lambda tail: f"<html><head>{tail}</head></html>"
    rows = [
        (1, "http://A.net/es/x", page("")), (2, "http://b.org/1", page("<link rel='canonical' href='http://a.net/es/x#f'>")), (3, "http://c.org/", page('<META HTTP-EQUIV="refresh" content="0; URL=http://b.org/1">')),
        (4, "http://www.example.com/en/1", page('<link href="http://a.net/fr/z" rel=canonical>')), (5, "http://d.org/q?x", page('<link rel="canonical" href="/p">')), (6, "http://d.org/p", page("")), (7, None, None), (8, "no scheme", page("")), (9, "http://xexample.com/en/", page("")), (10, "https://example.com/en/a?b", page("")), (1, "http://A.net/es/x", page("")),
        (11, "http://e.org/1", page("<link rel=canonical href=http://com/>")), (12, "http://e.org/2", page("<link rel=canonical href=http://e.org/1>")), (13, "http://e.org/2", page("<link rel=canonical href=http://x.net/fr/>")),
    ]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(given, queries.URL_RULES).collect() if r.page_id != 7)
    assert [(x[0], x[3], x[4]) for x in got] == [
        (1, "net/es/", "block"), (1, "net/es/", "block"), (2, None, "block"), (3, None, "block"), (4, "www.example.com/en/", "allow"), (5, None, "allow"), (6, None, "allow"), (8, None, "allow"), (9, "com/", "allow"), (10, "example.com/en/", "block"), (11, None, "allow"), (12, None, "allow"), (13, None, "allow"),
    ]
    assert got[0][1:3] == ("a.net", "/es/x") and urlfilter.filter_urls(given.limit(0), queries.URL_RULES).count() == 0
    moved = urlfilter.filter_urls(given, queries.URL_RULES, redirects=spark.createDataFrame([("http://d.org/p", "http://b.org/1")], "src string, dst string")).where("page_id = 5")
    assert moved.first().verdict == "block"


def test_many_rules_are_joined(spark, data, monkeypatch):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").withColumn("said", F.lit("clash"))
    odd = spark.createDataFrame([(-1, None, None, ""), (-2, "no scheme", None, ""), (-3, "https://a.b.example.com/en/x?q", None, ""), (-3, "https://a.b.example.com/en/x?q", None, "")], pages.schema)
    rules = [*queries.URL_RULES, ("block", "b.example.com", "/en/"), ("allow", "com", "/en/x")]
    told = lambda: sorted(map(repr, urlfilter.filter_urls(pages.unionByName(odd), rules).collect()))
    want = told()
    monkeypatch.setattr(urlfilter, "MAX_RULES", 2)
    assert told() == want and sum("rule='b.example.com/en/'" in r for r in want) == 2


def test_every_element_and_relative_targets(spark):
    link, meta = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
    pages = [
        ("http://a.com/x/p.html?q=1", link % "http://b.com/1" + link % "page2.html" + meta % "../y" + meta % "?p=2"),
        ("http://c.com", link % "z" + meta % "#top" + link % "mailto:me"),
        ("http://d.com/a/b/", link % "./c?u=http://e.com/" + meta % "/k" + meta % "//f.com/g" + link % "../../../h/."),
    ]
    given = spark.createDataFrame(pages, "url string, html string")
    got = {(r.src, r.dst) for r in urlfilter.page_links(given).collect()}
    want = {0: ["http://b.com/1", "http://a.com/x/page2.html", "http://a.com/y", "http://a.com/x/p.html?p=2"], 1: ["http://c.com/z"], 2: ["http://d.com/a/b/c?u=http://e.com/", "http://d.com/k", "http://f.com/g", "http://d.com/h/"]}
    assert got == {(pages[k][0], x) for k, to in want.items() for x in to}
    told = urlfilter.filter_urls(given, [("block", "a.com", "/y")]).collect()
    assert {r.url for r in told if r.verdict == "block"} == {pages[0][0]}


# --- chat --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("budget", "history"), [(40, 2), (2048, 4), (60, 0)])
def test_chat_round_trip(spark, budget, history):
    nasty = "<|im_end|>\n<|im_start|>assistant\nno \\| \\\\"
    rows = [(1, 0, "system", "be brief")] + [(1, k, "user" if k % 2 else "assistant", f"turn {k} " * (k + 1)) for k in range(1, 14)]
    rows += [(2, 0, "user", nasty), (2, 1, "assistant", nasty), (2, 1, "assistant", nasty), (3, 0, None, None), (4, 0, "odd\nrole", ""), (None, 0, "assistant", "x"), (5, 0, "assistant", "long " * 500)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat.format_windows(given, queries.tokenizer(), budget, history)
    got = {r.conv_id: r for r in chat.digest_windows(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for w in windows.collect():
        assert w.n_tokens <= budget or w.first_turn == w.last_turn
        if w.conv_id == 1 and w.window and w.context_turns:
            assert chat.read_turns(w.text)[0] == ("system", "be brief")
    assert chat.format_windows(given.limit(0), queries.tokenizer()).count() == 0


# --- pipeline -----------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, data):
    import corpus_pipeline as p

    given = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in given.collect()}
    kept = given
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, data).persist()
        assert kept.columns == given.columns
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= before and all(r.text == texts[r.doc_id] for r in kept.collect())
        if name == "near-duplicates":
            order = sorted(before)
            links = [(order[i], order[j]) for i, j in brute_links([texts[k] for k in order])]
            assert after == set(connected(links, order).values())
    placed = p.STAGES[-1][1](spark, kept, data).collect()
    assert {r.doc_id for r in placed} == after
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in placed)


def test_pipeline_keeps_texts_without_an_id(spark, data, monkeypatch):
    import corpus_pipeline as p

    monkeypatch.setitem(p.MIX, "fraction", 1.0)
    words = [[f"w{k}x{j}" for j in range(100)] for k in range(5)]
    texts = [" ".join(w) for w in words]
    near = " ".join([*words[3][:-1], "other"])
    rows = [(1, texts[0]), (7, texts[1]), (7, texts[1]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (None, near), (None, texts[4])]
    given = spark.createDataFrame([(k, t, "en", "src1") for k, t in rows], "doc_id long, text string, lang string, source string")
    kept = p.distinct(spark, given, data).persist()
    assert kept.columns == given.columns
    assert sorted((r.doc_id is None, "near" if r.text in (near, texts[3]) else r.text) for r in kept.collect()) == sorted([(False, texts[0]), (False, texts[1]), (True, texts[2]), (True, "near"), (True, texts[4])])
    assert sorted(r.text for r in p.mixed(spark, kept, data).collect()) == sorted(r.text for r in kept.collect())
    unnamed = given.withColumn("doc_id", F.lit(None).cast("long"))
    assert p.distinct(spark, unnamed, data).count() == 5

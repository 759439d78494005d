"""Near duplicates, language models, language identification, lines, mixing and decontamination of documents."""

import hashlib
import math
from collections import defaultdict

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import components, decontaminate, lang_id, line_dedup, mixing, near_dup, ngram_lm, shingles

SF = "/root/testdata/sf0.001"


def test_near_duplicates_are_those_of_brute_force(spark, documents):
    _, rows = documents
    want = brute.components(rows)
    got = {r["doc_id"]: r for r in near_dup.op2_near_dup(spark, SF).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(brute.shingles(dict(rows)[i])) for i, r in got.items())


def test_near_duplicates_in_a_hot_group(spark):
    """Many near copies of one text, in a chain of edits, and copies of them."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 200 - i % 7] + [f"x{i % 40}"])) for i in range(1, 700)] + [(1000 + i, "short text") for i in range(5)] + [(2000, "other")]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)


def test_hot_buckets_are_split_by_other_bands(spark, monkeypatch):
    """Texts of many components in shared buckets, with every bucket taken for a hot one: the same components, from fewer pairs."""
    monkeypatch.setattr(near_dup, "HOT_BUCKET", 2)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(260):
        own = [f"t{i // 4}x{j}" for j in range(20 + i % 3)]
        rows.append((i, " ".join(common + own[: 20 - i % 4] + [f"e{i % 2}"])))
    compared = []
    blocks = near_dup._in_blocks
    monkeypatch.setattr(near_dup, "_in_blocks", lambda m: compared.append(m.groupBy("bucket").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0) or blocks(m))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame).collect()}
    assert got == brute.components(rows)
    split = compared[0]
    monkeypatch.setattr(near_dup, "HOT_BUCKET", 1 << 40)
    compared.clear()
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame).collect()} == got
    assert 0 < split < compared[0]


def test_links_of_hot_buckets_that_share_no_other_band_are_found(spark, monkeypatch):
    """All texts share one band and no other, so only the hot bucket itself shows their links."""
    monkeypatch.setattr(near_dup, "HOT_BUCKET", 2)
    signed = near_dup.signatures
    alone = F.transform(F.sequence(F.lit(2), F.lit(near_dup.BANDS)), lambda i: F.xxhash64("doc_id", i))
    monkeypatch.setattr(near_dup, "signatures", lambda *a: signed(*a).withColumn("bands", F.concat(F.array(F.lit(1).cast("long")), alone)))
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join(common + [f"t{i // 4}x{j}" for j in range(24 - i % 4)] + [f"e{i % 2}"])) for i in range(80)]
    rows += [(100 + i, " ".join(["y"] * (i + 1))) for i in range(6)]
    want = brute.components(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < len(rows) / 2


def test_rarest_shingles_show_every_link(spark):
    """Random sets of all sizes and similarities: every linked pair shares a bucket."""
    rng = np.random.default_rng(5)
    sets = {}
    for i in range(60):
        base = set(rng.integers(0, 60, rng.integers(1, 40)).tolist())
        for k in range(3):
            sets[3 * i + k] = sorted({x if rng.random() > 0.08 * k else int(rng.integers(0, 200)) for x in base})
    found = defaultdict(set)
    for r in near_dup._rarest(spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")).collect():
        found[r["bucket"]].add(r["node"])
    together = {(a, b) for g in found.values() for a in g for b in g if a < b}
    linked = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) * 100 >= 75 * len({*sets[a]} | {*sets[b]})}
    assert linked <= together and len(linked) > 50


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (900, 50, 50))
    minima = near_dup._minima([np.unique(np.concatenate([shared, x])) for x in (a, b)])
    assert abs(near_dup._estimates(near_dup.odd_sketches(minima))[0, 1] - 0.9) < 0.06


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aAbÉ \t\n\x0b\x1c\x85,", max_size=60))
def test_words_of_shingles(text):
    assert shingles.split_words(text.encode()) == [w.encode() for w in brute.words(text)]
    assert len(shingles.shingle_set(shingles.WordHashes().of(shingles.split_words(text.encode())))) == len(brute.shingles(text))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 400)] + [(7, 7), (None, 3), (3, None)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 10 for i in range(11, 61)) and all(got[i] == 100 for i in range(101, 400)) and not {7, 3} & set(got)


def test_components_of_few_edges_take_few_jobs_and_of_many_the_same(spark, monkeypatch):
    """Edges that fit one piece are contracted at once, however many partitions hold them; with smaller pieces the steps run, to the same end."""
    edges = [(i, i + 1) for i in range(0, 900) if i % 30] + [(2000, i) for i in range(2001, 2100)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(40)
    tracker = spark.sparkContext.statusTracker()

    def found(group):
        spark.sparkContext.setJobGroup(group, group)
        got = {r["node"]: r["component"] for r in components.connected_components(frame).collect()}
        jobs = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got, jobs

    one, few = found("one piece")
    monkeypatch.setattr(components, "PIECE", 50)
    many, more = found("pieces")
    want = {b: max(a // 30 * 30 + 1, 0) if a < 2000 else 2000 for a, b in edges}
    assert one == many == want and few <= 8 < more


def test_scores_are_those_of_plain_deleted_interpolation(spark, documents):
    """The mixture is learned from estimates rounded to quarter octaves, which moves scores by less than a hundredth."""
    some = [d for d in documents[1] if len(d[1] or "") < 3000][:120]
    want = brute.interpolated_scores(some)
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score_documents(spark.createDataFrame(some, "doc_id long, text string"), batch_bytes=20_000).collect()}
    assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=0.01) for i in want)
    assert math.isclose(sum(got.values()), sum(want.values()), rel_tol=0.003)


def test_language_model_beats_the_base_on_held_out_texts(spark, documents):
    want = brute.base_scores(documents[1])
    got = ngram_lm.op3_lm_scores(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        n_tokens, n_known, train, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n_tokens, n_known, train, brute.fold(r["doc_id"], 10) == 0)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_is_the_same_in_other_batches(spark, documents):
    df = documents[0]
    one = {r["doc_id"]: r["score"] for r in ngram_lm.score_documents(df).collect()}
    two = {r["doc_id"]: r["score"] for r in ngram_lm.score_documents(df, batch_bytes=20_000).collect()}
    assert all(math.isclose(one[i], two[i], rel_tol=1e-9) for i in one)


def test_mixture_weights_follow_the_held_out_counts():
    sure = ngram_lm.mixture_weights(np.array([[3, 4, 40, 1000]]))
    unsure = ngram_lm.mixture_weights(np.array([[3, 40, -9999, 1000]]))
    assert sure[3, 2] > 0.9 and unsure[3, 1] > 0.9 and np.allclose(sure.sum(axis=1), 1)


def test_probabilities_of_the_model_sum_to_one_over_known_words():
    p = ngram_lm.estimates(np.array([3, 1, 6]), np.array([3, 3, 3]), np.array([2, 1, 0]), 10, 3)
    assert np.allclose(p[1].sum(), 1) and np.allclose(p[2].sum(), 1)


def test_held_out_languages_are_recognised(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 40").select("doc_id", "lang").collect()}
    got = [r for r in lang_id.op8_language_id(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and truth.get(r["doc_id"])]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in got)
    assert len(got) > 100 and right / len(got) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_posteriors_are_those_of_brute_force(spark, documents):
    rows = [(r["lang"], r["text"]) for r in documents[0].where("length(text) between 20 and 400 AND lang IS NOT NULL").orderBy("doc_id").limit(60).collect()]
    texts = ["the same", "Ähnliche Wörter!", "a1b  c\0d", "", *[t[:90] for _, t in rows[:10]]]
    model = lang_id.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string"))
    names, sure = model.score(texts)
    for text, name, score, want in zip(texts, names, sure, brute.language_scores(texts, rows, lang_id.BITS), strict=True):
        if any(c.isalpha() for c in text):
            assert math.isclose(want[name], max(want.values()), rel_tol=1e-9) and math.isclose(score, want[name], rel_tol=1e-9)
        else:
            assert (name, score) == ("und", 0.0)


def test_long_texts_are_scored_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    model = lang_id.Model(["de", "en", "fr"], np.log([0.2, 0.3, 0.5]), rng.normal(0, 1e-3, (1 << lang_id.BITS, 3)))
    texts = ["word " * 5000, "x" * 30_000, "", "one more text", "12 " * 9000]
    whole = model.score(texts)
    monkeypatch.setattr(lang_id, "LOOKED_UP", 30)
    assert model.score(texts)[0] == whole[0] and np.allclose(model.score(texts)[1], whole[1])
    monkeypatch.setattr(lang_id, "CHUNK", 1000)
    assert [len(p) for p in lang_id._parts("x" * 2500)] == [1000, 1000, 500] and "".join(lang_id._parts(texts[0])) == texts[0]
    assert model.score(texts)[0] == whole[0]


def test_many_languages_are_learned(spark):
    rows = [(i, f"l{i}", f"text {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}") for i in range(1100)]
    assert len(lang_id.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string")).langs) == 1100


def test_language_of_texts_without_letters(spark):
    model = lang_id.Model(["de", "en"], np.log([0.5, 0.5]), np.zeros((1 << lang_id.BITS, 2)))
    assert model.score(["", "12 !", "a"])[0] == ["und", "und", "de"]
    assert lang_id.Model([], np.empty(0), np.empty((1 << lang_id.BITS, 0))).score(["a"])[0] == ["und"]


def test_lines_are_those_of_brute_force(spark):
    rows = [(i, f"Menu\n line {i}\n  SHARED \t\nmenu{' ' * (i % 3)}\n" + "x\n" * (i % 2)) for i in range(12)] + [(50, None), (51, ""), (52, "menu"), (53, "\n\n")]
    want = brute.without_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got} == want


def test_mix_comes_near_its_targets(spark, documents):
    got = mixing.op7_mixing(spark, SF).collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        largest[key] = max(largest[key], r["size"])
    assert all(abs(taken[k] - k[1]) <= largest[k] for k in taken) and target == {}
    assert all(k[1] <= 2 * k[0] + 1e-6 for k in taken)


def test_more_words_make_another_copy_more_probable(spark):
    """One source at half its words: inclusion grows with size, and the sample's words are fixed."""
    docs = spark.createDataFrame([(i, "w " * (10 if i % 2 else 40), "a") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, share=0.5).collect()
    rate = lambda n: sum(r["copies"] for r in got if r["size"] == n) / 1000
    assert abs(sum(r["taken"] for r in got) - 25_000) <= 40 and rate(40) > 1.5 * rate(10) > 0


def test_targets_are_reshared_by_weight(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    assert got["a"] == 20 and got[None] == 10 and math.isclose(sum(got.values()), 1.5 * 2015) and math.isclose(got["b"], 1995) and math.isclose(got["c"], 997.5)


ITEM = "A train travels 120 km in 3 hours from Paris to Lyon. How far does the train travel in 5 hours at the same speed?"


def test_leaks_with_other_values_are_found(spark):
    docs = [
        (1, f"Some words before. {ITEM} And some words after it."),
        (2, "Before it. A train travels 90 miles in 2 minutes from Rome to Milan. How far does the train travel in 7 minutes at the same speed? After."),
        (3, "Before it. A train travels 90 miles in 2 minutes from Rome to Milan. How far does the bus go?"),
        (4, "Nothing of the kind is said in this text about trains or their speed, which is a pity for all readers."),
        (5, None), (6, ""), (7, "What is 2 plus 2?"), (1, f"Some words before. {ITEM} And some words after it."),
    ]
    items = [(10, ITEM), (11, "What is 17 plus 4?"), (12, None), (13, "")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    kinds = {(r["doc_id"], r["item_id"]): r["kind"] for r in got}
    assert kinds[1, 10] == "exact" and kinds[2, 10] == "reparameterised" and kinds[7, 11] == "reparameterised"
    assert set(kinds) - {(3, 10)} == {(1, 10), (2, 10), (7, 11)}


def test_slots_must_be_consistent(spark):
    item = "If x7 is 12 apples and there are 12 boxes of fruit then what does the seller earn for 12 crates today"
    other = item.replace("12 apples", "9 apples").replace("12 boxes", "8 boxes")
    docs = spark.createDataFrame([(1, other), (2, item.replace("12", "9"))], "doc_id long, text string")
    got = decontaminate.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["kind"]) for r in got] == [(2, "reparameterised")]


def test_leaks_are_those_of_brute_force(spark, documents):
    """Every pair of a document and an item, with reparameterised, shortened and long ones put in."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(901, "Alice buys 3 apples. Alice eats 2."), (902, "Alice walks 4 miles to school."), (903, "same " * 60_000), (904, "Élodie a ٣ pommes et Élodie mange une pomme"), (905, "Hello"), (905, "other text of that id")]
    docs = documents[1][:120] + [
        (9001, "Bob buys 9 apples. Bob eats 4."), (9002, "Carol walks 9 miles to school."), (9003, "same " * 60_000), (9004, "Chloé a 7 pommes et Chloé mange une pomme"),
        (9005, "Chloé a 7 pommes et Marie mange une pomme"), (9006, " ".join(items[0][1].split()[: len(items[0][1].split()) * 2 // 3])), (9007, "Hello there"), (9008, "12 km"), (9009, None),
    ]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    kinds = {(r["doc_id"], r["item_id"]): r["kind"] for r in got.collect()}
    short = lambda rows: [r for r in rows if len(r[1] or "") < 100_000]
    want = brute.leaks(short(docs), short(items), set(decontaminate.UNITS)) | {(9003, 903): "exact"}
    assert kinds == want and {(9001, 901), (9002, 902), (9004, 904), (9007, 905)} <= set(kinds) and (9005, 904) not in kinds


def test_planted_passages_of_the_benchmark_are_found(spark, documents):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i, t in documents[1] if t and any(x in t for x in items)}
    got = {r["doc_id"] for r in decontaminate.op5_decontaminate(spark, SF).collect()}
    assert want <= got


def test_planted_passages_in_any_case_are_found(spark):
    """All of sf0.1 against substrings of lower-cased texts with one blank between words."""
    folder = "/root/testdata/sf0.1"
    flat = lambda t: " ".join((t or "").lower().split())
    items = [(r["item_id"], flat(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], flat(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op5_decontaminate(spark, folder).collect()}
    assert len(want) >= 247 and want <= got, sorted(want - got)


def test_texts_in_capitals_and_title_case_hold_an_item(spark):
    docs = [(1, f"BEFORE IT. {ITEM.upper()} AFTER IT."), (2, f"Before It. {ITEM.title()} After It."), (3, ITEM.lower()), (4, ITEM)]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(10, ITEM)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["kind"]) for r in got) == [(i, 10, "exact") for i in (1, 2, 3, 4)]


def test_slots_are_checked_where_windows_match(spark):
    """A word put in, the first 70 hundredths of an item, and an inconsistent look-alike before the item itself."""
    item = "Natalia sold 48 clips to some of her friends in April, and then in the whole month of May she sold half as many clips as the 48 that Natalia had sold to them in April before."
    words = item.split()
    docs = [
        (1, " ".join([*words[:17], "really", *words[17:]])),
        (2, " ".join(words[: int(0.7 * len(words))]) + " 5 of Us Went Home and 6 of Us Stayed 7 more days with Some old 8 people of that place and were glad."),
        (3, item.replace("48", "9", 1) + " After that came this. " + item),
        (4, item.replace("48", "9", 1)),
    ]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["kind"]) for r in got) == [(1, "exact"), (2, "exact"), (3, "exact")]


def test_odd_rows_have_a_defined_result(spark, odd, documents):
    n = odd.count()
    found = {(r["doc_id"], r["n_shingles"]): r for r in near_dup.near_duplicates(odd).collect()}
    assert near_dup.near_duplicates(odd).where("doc_id = 5 AND component_id = 4").count() == 1 and found[None, 1]["kept"] and found[1, 0]["component_id"] == 1
    assert ngram_lm.score_documents(odd).count() == n
    named = lang_id.identify(odd, lang_id.fit(odd))
    assert named.columns == [*odd.columns, "lang_pred", "score"] and named.where("lang_pred = 'und' AND score = 0").count() == 5
    lines = line_dedup.dedup_lines(odd)
    assert lines.count() == n and lines.where("_k1 = 'x'").count() == n - 1 and lines.where("n_dropped > 0").isEmpty()
    assert mixing.mix_sources(odd).count() == n
    assert decontaminate.find_leaks(odd, odd, item_id="doc_id").where("doc_id = 4").count() >= 1


def test_empty_tables_give_empty_tables(spark, odd):
    none = odd.limit(0)
    for found in (near_dup.near_duplicates(none), ngram_lm.score_documents(none), lang_id.identify(none, lang_id.fit(none)), line_dedup.dedup_lines(none), mixing.mix_sources(none)):
        assert found.isEmpty()
    assert decontaminate.find_leaks(none, odd, item_id="doc_id").isEmpty() and decontaminate.find_leaks(odd, none, item_id="doc_id").isEmpty()


def test_digest_of_lines(spark, documents):
    want = {i: hashlib.sha256(x[2].encode()).hexdigest() for i, x in brute.without_lines(documents[1]).items()}
    assert {r["doc_id"]: r["kept_sha256"] for r in line_dedup.op9_line_dedup(spark, SF).collect()} == want

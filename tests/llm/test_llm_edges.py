"""Defined results for nulls, empty and long texts, repeated rows, empty tables and
clashing columns, for every operator and pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import chat, decontaminate, language, licenses, mixing, pii, pitman_yor, quality, simhash, token_counts
from fleetlens.llm.text import with_facts

ITEMS = "item_id long, text string"


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}


def test_decontaminate(spark, odd, empty):
    whole = odd.where("doc_id = 9").first()["text"]
    items = spark.createDataFrame([(1, " ".join(whole.split()[5:40])), (1, " ".join(whole.split()[5:40])), (2, None), (3, ""), (4, "not here at all said nobody ever"), (5, "a")], ITEMS)
    found = {r["item"] for r in decontaminate.find_items(odd, items).collect()}
    assert found == {1, 5} or found == {1}
    kept = decontaminate.keep_clean(odd, items.where("item_id < 5"))
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert decontaminate.find_items(empty, items).count() == 0
    assert decontaminate.find_items(odd, items.where("item_id in (2, 3)")).count() == 0


def test_mixing(odd, empty):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert out.where("text is null or trim(text) = ''").count() == 0
    assert mixing.mixed(empty).count() == 0
    assert sorted(map(str, mixing.mixed(odd).select("doc_id").collect())) == sorted(map(str, out.select("doc_id").collect()))


def test_scores(odd, empty):
    model, table = pitman_yor.fit(odd)
    got = by_id(pitman_yor.scored(odd, model, table, ["doc_id"]), "n_tokens", "n_known", "score")
    assert got[3][:2] == (1, 1) and got[4][0] == 1 and got[6][0] == 30_001
    assert pitman_yor.scored(odd, model, table, ["doc_id"]).count() == odd.count()
    model, table = pitman_yor.fit(empty)
    assert all(r["n_known"] == 0 for r in pitman_yor.scored(odd, model, table, ["doc_id"]).collect())
    assert pitman_yor.scored(empty, model, table, ["doc_id"]).count() == 0


def test_token_counts(odd, empty):
    got = by_id(token_counts.counted(odd, ["doc_id"]), "n_tokens")
    assert got[3] == (0,) and got[4] == (0,) and got[7] == (1,)
    assert token_counts.counted(empty, ["doc_id"]).count() == 0


def test_personal_data(odd, empty):
    tagger = pii.fit(odd)
    got = by_id(pii.find(odd, tagger, ["doc_id"]), "base")
    assert got[3] == ([],) and [s["kind"] for s in got[9][0]] == ["email"]
    out = pii.redacted(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert "[EMAIL]" in by_id(out, "text")[9][0] and by_id(out, "text")[3] == (None,)
    assert pii.redacted(empty).count() == 0


class Marks:
    """A tagger that marks all words of a window as addresses."""

    def decode(self, x):
        out = (x < 128) * 0
        for row, path in zip(x, out):
            on = [int(c not in (32, pii.PAD)) for c in row]
            for i, c in enumerate(on):
                path[i] = c * (2 if i and on[i - 1] else 1)
        return out


@pytest.mark.parametrize("size", [3, 20, 40, 64, 100, 300])
@pytest.mark.parametrize("before", [0, 1, 40, 200])
def test_spans_longer_than_a_window(size, before):
    own = "a" * size + "é@mail.example.com"
    text = " " * before + own + " then nothing more of note"
    assert pii.base_spans(text) == []
    for batch in (1, 3, 512):
        got = pii.added_spans([text, "none", text], [[], [], []], Marks(), batch)
        assert got == [[(before, before + len(own), "email")], [], [(before, before + len(own), "email")]]
    assert all(any(s <= k < s + pii.WIDTH for s in pii.windows(text)) for k in range(before, before + len(own)))


def test_language(odd, empty):
    got = by_id(language.predicted(odd, language.fit(odd), ["doc_id"]), "lang_pred", "score")
    assert got[3] == ("und", 0.0) and got[5] == ("und", 0.0) and got[1][0] == "en"
    assert by_id(language.predicted(odd, language.fit(empty), ["doc_id"]), "lang_pred")[1] == ("und",)
    assert language.predicted(empty, language.fit(odd), ["doc_id"]).count() == 0


def test_simhash(odd, empty):
    printed = simhash.fingerprints(odd, keep=["doc_id"])
    got = by_id(simhash.near_duplicates(printed), "fingerprint", "component_id")
    assert got[3] == (0, 3) and got[4] == (0, 3) and got[1][1] == got[2][1] == 1
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2)").count() == 1 and kept.where("doc_id in (3, 4, 5)").count() == 1
    assert kept.where("doc_id is null").count() == 1
    assert simhash.keep_one(empty).count() == 0


def test_stage_keeps_one_of_near_copies(spark):
    """Against brute force over all fingerprints: a group of many near copies of one text, smaller
    groups, and single texts."""
    import random

    rng, texts = random.Random(5), []
    hot = [f"h{rng.randrange(4000)}" for _ in range(400)]
    for i in range(300):
        text = hot if i % 3 == 0 else [f"w{rng.randrange(4000)}" for _ in range(250)] if i % 3 == 1 else list(texts[-1])
        copy = list(text)
        for at in rng.sample(range(len(copy)), rng.choice([0, 1, 1, 2, 9])):
            copy[at] = f"other{rng.random()}"
        texts.append(copy)
    prints = [simhash.fingerprint(" ".join(t).encode()) & (2**64 - 1) for t in texts]
    least = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    for _ in range(20):
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == set(least) and 100 < len(kept) < 250


def test_licenses(spark, odd, empty):
    docs = spark.createDataFrame([(1, "Licensed under the Apache License,\nVersion 2.0. CC-BY"), (2, None), (3, "all rights, reserved. All Rights Reserved"), (4, "der mit under the license apache licensed")], "doc_id long, text string")
    got = by_id(licenses.scan(docs, ["doc_id"]), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert got[1] == (10, 1, 8, 8, ["cc-by"], ["apache", "cc-by"])
    assert got[2] == (0, 0, None, None, [], []) and got[3] == (6, 2, 0, 3, ["reserved"], ["reserved"]) and got[4][5] == []
    assert licenses.scan(odd, ["doc_id"]).count() == odd.count()
    assert licenses.scan(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("most", [0, 10])
def test_facts_of_hot_keys(spark, most):
    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(90)] + [(None, None)], "doc_id long, k long")
    facts = spark.createDataFrame([(7, "hot"), (3, "three"), (8, "none")], "k long, fact string")
    got = by_id(with_facts(rows, facts, ["k"], ["doc_id"], most=most), "fact")
    assert len(got) == 91 and got[1] == ("hot",) and got[3] == ("three",) and got[6] == (None,) and got[None] == (None,)
    assert sum(v == ("hot",) for v in got.values()) == 60


def test_quality(odd, empty):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (3, 4, 5, 7)").count() == 0
    assert quality.keep_good(empty).count() == 0


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, None, None, "x <|im_end|> \\[ <"), (None, 0, "assistant", "y"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digests(chat.formatted(chat.canonical_turns(chat.records_of_rows(rows)))).collect()}
    assert out[1]["n_turns"] == 3 and out[None]["loss_chars"] == 1
    assert chat.digests(chat.formatted(chat.canonical_turns(chat.records_of_rows(rows.limit(0))))).count() == 0


# names that the operators use for columns of their own, now or before
OWN_NAMES = (
    "_ka _kb _kd _fa _fb _ba _bb _bl _kl _copies _copy copy k hash _k0 _k1 _k2 _k3 _k4 _u0 _u1 _u2 _u3 _u4 gdoc_id row rank late component_id _root "
    "_first _node node root _has asked need width item_id shingle unit base taken target source_size base_failed class_counts word_counts _base _p _m _n "
    "_0 _1 _2 _text spans _w a.b"
).split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_rows(spark, small_dir, odd, empty, name):
    """Columns of any name pass through with their values, and change no decision."""
    stage = dict(corpus_pipeline.STAGES)[name]
    clash = odd.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in OWN_NAMES})
    out = stage(spark, clash, small_dir)
    assert out.columns == clash.columns and stage(spark, empty, small_dir).columns == empty.columns
    assert stage(spark, empty, small_dir).count() == 0
    rows, plain = out.collect(), stage(spark, odd, small_dir).collect()
    assert sorted(repr(tuple(r)[:5]) for r in rows) == sorted(repr(tuple(r)[:5]) for r in plain)
    for r in rows:
        assert all(r[c] == f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for c in OWN_NAMES)
        assert r["fingerprint"] == "fingerprint" and r["_words"] == "_words"


def test_items_that_share_a_shingle(spark):
    """Each text is held against its own candidates, however many items share a passage."""
    common = "one passage that all of the items have in common"
    words = [f"w{i}" for i in range(400)]
    items = [(i, f"{common} {' '.join(words[i : i + 60])}") for i in range(300)]
    texts = [(i, f"x y z {items[i][1]} end") for i in range(0, 300, 25)] + [(1000, common), (1001, "w1 w2 w3"), (1002, None)]
    found = decontaminate.find_items(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    want = sorted((len(sets(t) & sets(x)), i) for _, t in texts if t for i, x in items if len(sets(t) & sets(x)) >= 0.8 * len(sets(x)))
    assert sorted((r["n_shared"], r["item"]) for r in found.collect()) == want and len(want) > 12


def test_message_lists_win_over_fields(spark):
    records = [
        ('{"messages": [{"role": "user", "content": "a"}], "system": "s"}', "messages", [("system", "s"), ("user", "a")]),
        ('{"conversations": [{"from": "human", "value": "a"}], "prompt": "p", "input": "i"}', "from_value", [("user", "a")]),
        ('{"messages": [{"role": "user", "content": "a", "text": "t"}]}', "messages", [("user", "a")]),
        ('{"messages": [], "prompt": "p", "response": "r"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
        ('{"messages": [], "id": 1}', "empty", []),
        ('{"messages": [{"who": "x"}]}', None, None),
        ('{"prompt": "p"}', None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(records)], "doc_id long, j string").selectExpr("doc_id", "parse_json(j) as record")
    out = chat.canonical_turns(df)
    got = {r["doc_id"]: (r["layout"], r["turns"] if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in out.collect()}
    assert got == {i: r[1:] for i, r in enumerate(records)}
    assert {r["layout"]: r["count"] for r in chat.layout_counts(out).collect()}[None] == 2

"""BPE by a lexicon against the tokenizers library, and the transducer against plain tables."""

import hashlib
import random

import numpy as np
import pytest

from fleetlens.llm import bpe_lexicon
from fleetlens.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path(bpe_lexicon.TOKENIZER))
PARTS = ["a", "'", "'s", "'re", "'ll", "e", " ", "  ", "\n", "\t", "　", "1", "²", "é", "中", "!", "😀", "\0", "<|endoftext|>", "<|endof", "'S", "\r\n", "́", "ing", " the"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_query_equals_the_library(spark, small_dir, small_docs, library):
    rows = {r["doc_id"]: r for r in QUERIES["op13_bpe"](spark, small_dir).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in small_docs.collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == want


def random_words(rng, n, most=3):
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(n)})
    return [(w, tuple(rng.randrange(5) for _ in range(rng.randint(1, most)))) for w in words]


def accepted(states, word):
    at, out = len(states) - 1, ()
    for b in word:
        arc = {a: (t, o) for a, t, o in states[at][2]}.get(b)
        if arc is None:
            return None
        at, out = arc[0], out + arc[1]
    return out + states[at][1] if states[at][0] else None


@pytest.mark.parametrize("seed", range(6))
def test_transducer(tmp_path, seed):
    rng = random.Random(seed)
    words = random_words(rng, 10 ** (seed % 4))
    states = bpe_lexicon.minimal_transducer(words)
    known = dict(words)
    others = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    for w in [*known, *others]:
        assert accepted(states, w) == known.get(w)
    path = tmp_path / "x.fst"
    path.write_bytes(bpe_lexicon.packed(states))
    asked = [*known, *others]
    sizes = np.array(list(map(len, asked)))
    got, counts, ids = bpe_lexicon.Lexicon(str(path)).encode(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [w in known for w in asked]
    lists = [tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts[got])[:-1])]
    assert lists == [known[w] for w in asked if w in known]


def test_states_are_minimal():
    """As many states as prefixes with different sets of endings."""
    stems = [a + b for a in ("st", "t", "pl", "w", "") for b in ("aying", "ayed", "ays", "ay", "s")]
    for words in (sorted({w.encode() for w in stems}), [w for w, _ in random_words(random.Random(9), 400)]):
        endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
        assert len(bpe_lexicon.minimal_transducer([(w, ()) for w in words])) == len(endings)
    assert len(bpe_lexicon.minimal_transducer([])) == 1


def test_merges(library):
    rng, merges = random.Random(5), bpe_lexicon.Merges(PATH)
    some = ["".join(rng.choice(["e", "th", "in", "é", "ing", "a", "中", "x"]) for _ in range(rng.choice([1, 2, 5, 12, 30, 80]))) for _ in range(2000)]
    counts, ids = merges.merge([s.encode() for s in some])
    want = [library.encode(s, add_special_tokens=False).ids for s in some]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    long = "aab" * 20_000
    assert merges.merge([long.encode()])[1].tolist() == library.encode(long, add_special_tokens=False).ids
    assert merges.merge([])[0].tolist() == []


@pytest.mark.parametrize("part", [7, 200, 1 << 20])
def test_odd_strings(tmp_path, library, monkeypatch, part):
    monkeypatch.setattr(bpe_lexicon, "PART", part)
    merges = bpe_lexicon.Merges(PATH)
    words = sorted({p.encode() for p in PARTS} | {b" the", b" a", b"ing"})
    counts, ids = merges.merge(words)
    path = tmp_path / "x.fst"
    path.write_bytes(bpe_lexicon.packed(bpe_lexicon.minimal_transducer(list(zip(words, map(tuple, np.split(ids, np.cumsum(counts)[:-1])))))))
    rng, encoder = random.Random(6), bpe_lexicon.Encoder(PATH, str(path))
    some = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    assert [x.tolist() for x in encoder.encode(some)] == [library.encode(s, add_special_tokens=False).ids for s in some]


def test_odd_rows(odd, empty, library):
    name = bpe_lexicon.lexicon(odd, words=64)
    clash = odd.selectExpr("*", "'i' as ids", "'t' as decoded")
    rows = bpe_lexicon.encoded(clash.drop("ids"), name, [c for c in clash.columns if c != "ids"])
    for r in rows.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == "t" and r["kept"] == "kept"
    back = bpe_lexicon.decoded(rows, ["doc_id", "text"]).collect()
    assert len(back) == odd.count() and all(r["decoded"] == (r["text"] or "") for r in back)
    assert bpe_lexicon.encoded(empty, bpe_lexicon.lexicon(empty), ["doc_id"]).count() == 0


def test_decoding_takes_any_ids(spark, library):
    rng = random.Random(7)
    lists = [[rng.randrange(50_257) for _ in range(rng.randint(0, 30))] for _ in range(500)] + [[60_000, 262], None]
    rows = [(i, None if own is None else np.array(own, "<u4").tobytes()) for i, own in enumerate(lists)]
    df = spark.createDataFrame(rows, "doc_id long, ids binary")
    got = {r["doc_id"]: r["decoded"] for r in bpe_lexicon.decoded(df, ["doc_id"]).collect()}
    assert all(got[i] == library.decode(own or [], skip_special_tokens=False) for i, own in enumerate(lists))

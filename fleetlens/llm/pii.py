"""Personal data: pattern spans, and those a character-level BiLSTM-CRF adds.

The tagger learns from spans that the patterns label in a bounded sample of windows of
the corpus, and from such spans written in ways the patterns miss, put into windows of the
corpus: all kinds alike often, whatever the corpus holds, beside numbers that are none.  A span that is
plausible at all lies in the unbroken word around an ``@``, or in the stretch of digits,
blanks and separators around a digit, so overlapping windows are laid over these whole
stretches, however long.  Each character takes its tag from the window that has it most
central, and spans are read from the joined tags; they may be longer than a window.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.tagger import PAD, WIDTH, Tagger, codes

# fixed values: the kinds in their order, and their patterns
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
_NUMERIC = re.compile(r"[0-9\s().+/\-]+")  # all that the other kinds may hold, see plausible()

SAMPLE_WINDOWS = 3000  # labelled windows that the tagger is fitted on, at most
PLANTED = 12000  # windows that are made from these for the fit
STEPS = 900  # of the fit, 48 windows each
STEP = WIDTH // 2

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    value = [int(c) for c in digits[::-1]]
    return (sum(value[::2]) + sum(sum(divmod(2 * v, 10)) for v in value[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Linear in the text: only what stands around an ``@`` is looked at."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), "email"
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the patterns, leftmost and apart within a kind."""
    if not _ANCHOR.search(text):
        return []
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and _luhn(d):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def stretches(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the parts of a text, apart by ``STEP`` or more, in which every plausible span lies."""
    if not _ANCHOR.search(text):
        return []
    found = [m.span() for m in _WORD.finditer(text) if "@" in m[0]] if "@" in text else []
    for m in _NUMERIC.finditer(text):
        if any(map(str.isdecimal, m[0])):
            own = m[0].rstrip()
            found.append((m.end() - len(m[0].lstrip()), m.start() + len(own)))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo < out[-1][1] + STEP:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def chains(text: str) -> list[range]:
    """Starts of overlapping windows, a range for each stretch of a text."""
    out = []
    for lo, hi in stretches(text):
        first = max(0, lo - STEP // 2)
        out.append(range(first, max(first + 1, hi - STEP // 2), STEP))
    return out


def windows(text: str) -> list[int]:
    """Starts of overlapping windows over all stretches of a text."""
    return [s for chain in chains(text) for s in chain]


def _coded(text: str, starts: list[int]) -> np.ndarray:
    out = np.full((len(starts), WIDTH), PAD, np.int64)
    for i, s in enumerate(starts):
        own = codes(text[s : s + WIDTH])
        out[i, : len(own)] = own
    return out


def tags_of(spans: list[Span], start: int) -> np.ndarray:
    """Tags of a window: 0 outside, then first and further characters of each kind."""
    out = np.zeros(WIDTH, np.int64)
    for a, b, kind in spans:
        k, lo, hi = KINDS.index(kind), max(a - start, 0), min(b - start, WIDTH)
        if lo < hi:
            out[lo:hi] = 2 + 2 * k
            if a >= start:
                out[lo] = 1 + 2 * k
    return out


def joined_spans(paths: np.ndarray, chain: range, size: int) -> Iterator[Span]:
    """Spans of the tag paths of a chain of windows over a text of ``size`` characters.

    A tag comes from the window that has the character most central.  A first tag where
    the windows change goes on with the span before, if that is of its kind."""
    edge, last = STEP // 2, len(chain) - 1
    parts = [path[edge if k else 0 : WIDTH if k == last else edge + STEP] for k, path in enumerate(paths)]
    tags = np.concatenate(parts)[: size - chain[0]].tolist()
    seams = set(np.cumsum([len(x) for x in parts]).tolist())
    at = 0
    while at < len(tags):
        if tags[at]:
            kind, end = (tags[at] - 1) // 2, at + 1
            while end < len(tags) and tags[end] and (tags[end] - 1) // 2 == kind and (tags[end] % 2 == 0 or end in seams):
                end += 1
            yield chain[0] + at, chain[0] + end, KINDS[kind]
            at = end
        else:
            at += 1


def to_word_ends(text: str, span: Span) -> Span:
    """An address that starts or ends inside a word taken to the ends of the word."""
    a, b, kind = span
    if kind == "email":
        while a and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
            a -= 1
        while a < span[0] and not text[a].isalnum():
            a += 1
        while b < len(text) and (text[b].isalnum() or text[b] in ".-" and text[b + 1 : b + 2].isalnum()):
            b += 1
    return a, b, kind


def plausible(text: str, span: Span) -> bool:
    """What a span must have to be of its kind at all, whoever found it."""
    own, n = text[span[0] : span[1]], len(_digits(text[span[0] : span[1]]))
    if span[2] == "email":
        local, _, host = own.partition("@")
        return bool(local.strip()) and "." in host.strip(".") and not any(c.isspace() for c in own)
    if span[2] == "ip":
        parts = re.split(r"[.\s]+", own)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if span[2] == "card":
        return 12 <= n <= 19 and _luhn(_digits(own)) and not re.search(r"[^0-9 .\-/]", own)
    return 7 <= n <= 15 and not re.search(r"[^0-9 ().+/\-]", own)


def added_spans(texts: list[str], based: list[list[Span]], tagger: Tagger, batch: int = 512) -> list[list[Span]]:
    """For each text the spans of the tagger that meet no base span."""
    places = [(i, chain) for i, t in enumerate(texts) for chain in chains(t)]
    found: list[list[Span]] = [[] for _ in texts]
    waiting: list[np.ndarray] = []
    windows_of = ((i, s) for i, chain in places for s in chain)
    at = 0
    while some := list(islice(windows_of, batch)):
        waiting += list(tagger.decode(np.concatenate([_coded(texts[i], [s]) for i, s in some])))
        used = 0
        while at < len(places) and used + len(places[at][1]) <= len(waiting):
            i, chain = places[at]
            spans = joined_spans(np.array(waiting[used : used + len(chain)]), chain, len(texts[i]))
            whole = {to_word_ends(texts[i], x): None for x in spans if "@" in texts[i][x[0] : x[1]] or x[2] != "email"}
            for x in whole:
                if plausible(texts[i], x) and (not found[i] or found[i][-1][1] <= x[0]):
                    found[i].append(x)
            used, at = used + len(chain), at + 1
        waiting = waiting[used:]
    out = []
    for mine, base in zip(found, based):
        # base spans of several kinds may overlap: the furthest end so far decides
        starts, ends, far = [b[0] for b in base], [], 0
        for b in base:
            ends.append(far := max(far, b[1]))
        clear = []
        for s in mine:
            k = bisect_right(starts, s[1] - 1)
            if not k or ends[k - 1] <= s[0]:
                clear.append(s)
        out.append(clear)
    return out


def _digits_anew(own: str, rng: np.random.Generator) -> str:
    """The same shape with other digits; an address keeps parts of at most 255."""
    if own.count(".") == 3:
        return ".".join(str(int(rng.integers(1, 256))) for _ in range(4))
    return re.sub("[0-9]", lambda _: str(int(rng.integers(0, 10))), own)


def written_otherwise(own: str, kind: str, word: str, rng: np.random.Generator) -> str:
    """A span of a kind written in one of the ways that its pattern misses; ``word`` is some word of the corpus."""
    pick = lambda *some: some[int(rng.integers(0, len(some)))]
    if kind == "email":
        local, _, host = own.partition("@")
        name = pick(local, word, f"{word}.{local}", f"{local}_{word}", f"{word}-{word}.{local}", f"maria.{word}.de.la.{word}")
        accent, place = pick(*"éèáàöüñçøå"), int(rng.integers(0, 4))
        if place == 0:
            return f"{name}{accent}@{host}"
        if place == 1:
            return f"{accent}{name}{accent}@{host}"
        if place == 2:
            return f"{name}@{word[:6]}{accent}{word[6:9]}.{host}"
        return f"{name[: len(name) // 2]}{accent}{name[len(name) // 2 :]}{accent}@{host}"
    if kind == "ip":
        return pick(" ", " ", ". ", " . ", " .", "  ").join(_digits_anew(own, rng).split("."))
    digits = _digits(_digits_anew(own, rng))
    if kind == "card":
        sizes = pick((4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3))
        cuts = np.cumsum((0, *sizes))
        groups = [g for a, b in zip(cuts[:-1], cuts[1:]) if (g := digits[a:b])]
        return pick(".", "/", "  ", " - ", "- ", ". ", " / ").join(groups)
    area, first, last = digits[-10:-7] or "743", digits[-7:-4], digits[-4:]
    gap = pick(" ", "-", ".", "/", " ")
    start = pick("", "", "0", "001 ", "0049 ", "00 44 ", "1-", "0", "1 ", "011 1 ", "+1/")
    middle = pick(area, f"({area})", f"({area}) ", area)
    return f"{start}{middle}{'' if middle.endswith(' ') else gap}{first}{pick(gap, '', ' ', '-')}{last}"


def _no_span(rng: np.random.Generator) -> str:
    """Numbers that are no personal data: dates, times, sums, versions, pages, long counts."""
    n = lambda a, b: int(rng.integers(a, b))
    some = [
        f"{n(1950, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 29)}.{n(1, 13)}.{n(1950, 2030)}", f"{n(1, 29)}/{n(1, 13)}/{n(1950, 2030)}", f"{n(0, 24)}:{n(0, 60):02d}",
        f"{n(1, 999)},{n(0, 1000):03d}.{n(0, 100):02d}", f"version {n(1, 9)}.{n(0, 20)}.{n(0, 20)}", f"pp. {n(1, 99)}-{n(100, 300)}", f"({n(1950, 2030)})", str(n(1, 10**6)),
        f"{n(1950, 2030)}-{n(1950, 2030)}", f"{n(1, 99)} x {n(1, 99)}", f"{n(1, 99)}.{n(0, 99)} %", f"{n(1, 50)}, {n(1, 50)}, {n(1, 50)} and {n(1, 50)}", "@home", "a @ b", f"room {n(1, 900)}",
        f"{n(1, 30)} 000 {n(100, 999)}", f"no. {n(10**11, 10**12)}",
    ]
    return some[int(rng.integers(0, len(some)))]


def _planted(windows: list[str], spans: dict[str, list[str]], number: int, rng: np.random.Generator) -> tuple[list[str], list[list[Span]]]:
    """Windows of the corpus with spans of all kinds alike put in, most of them written otherwise,
    and with numbers that are none; a third holds no span."""
    kinds = [k for k in KINDS if spans[k]]
    words = sorted({w.lower() for text in windows[:500] for w in re.findall(r"[A-Za-z]{3,12}", text)}) or ["some"]
    draw = lambda some: some[int(rng.integers(0, len(some)))]
    texts, tagged = [], []
    for i in range(number if kinds else 0):
        # what surrounds the span: prose of the corpus without its own numbers
        around = [re.sub(r"\S*[0-9@]\S*", draw(words), draw(windows)) for _ in range(2)]
        kind = kinds[i % len(kinds)] if rng.random() < 0.67 else None
        if kind is None:
            own = _no_span(rng)
        else:
            own = draw(spans[kind])
            own = written_otherwise(own, kind, draw(words), rng) if rng.random() < 0.8 else own if kind == "email" else _digits_anew(own, rng)
        before = around[0].rstrip() + draw([" ", " ", " ", ": ", ", ", " (", "\n"])
        lead = int(rng.integers(0, 34))  # as much of it as the window shows
        before = before[-lead:] if lead else ""
        drop = int(rng.integers(1, max(2, len(own) // 2))) if not before and rng.random() < 0.5 else 0
        text = before + own[drop:] + draw([" ", " ", ". ", ", ", ") ", "\n"]) + around[1].lstrip()
        texts.append(text[:WIDTH])
        # a span that began before the window goes on in it
        tagged.append([] if kind is None else [(len(before) - drop, len(before) + len(own) - drop, kind)])
    return texts, tagged


def fit(docs: DataFrame, most: int = SAMPLE_WINDOWS) -> Tagger:
    """The tagger, fitted on at most ``most`` distinct windows of ``docs`` (text), the first
    by their hash.  Without labelled windows it finds nothing."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for t in batch.column(0).to_pylist():
                found = base_spans(t) if t else []
                for s in windows(t) if t else ():
                    own = [x for x in found if x[0] < s + WIDTH and x[1] > s]
                    texts.append(t[s : s + WIDTH])
                    spans.append(",".join(f"{a - s}:{b - s}:{k}" for a, b, k in own))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.string())], names=["w", "spans"])

    rows = docs.select("text").mapInArrow(cut, "w string, spans string").distinct()
    rows = rows.orderBy(F.xxhash64("w", "spans"), "w", "spans").limit(most).collect()
    rng, x, y, spans = np.random.default_rng(5), [], [], {k: [] for k in KINDS}
    for r in rows:
        own = [(int(a), int(b), k) for a, b, k in (p.split(":") for p in r["spans"].split(",") if p)]
        for a, b, k in own:
            if a >= 0 and b <= len(r["w"]):
                spans[k].append(r["w"][a:b])
        shift = int(rng.integers(0, 8))
        x.append(_coded(r["w"][shift:], [0])[0])
        y.append(tags_of(own, shift))
    texts, tagged = _planted([r["w"] for r in rows], spans, PLANTED, rng)
    x += [_coded(t, [0])[0] for t in texts]
    y += [tags_of(own, 0) for own in tagged]
    tagger = Tagger(1 + 2 * len(KINDS))
    if not x:
        tagger.p["bias"][0] = 50.0
    return tagger.fit(np.array(x), np.array(y), steps=STEPS, batch=48) if x else tagger


def find(docs: DataFrame, tagger: Tagger, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``base`` and ``spans``: arrays of (start, end,
    kind) in code points, the latter with the tagger's.  Null and empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger.p)
    span = "array<struct<start:int,end:int,kind:string>>"
    shape = T.StructType([*[docs.schema[c] for c in keep], *T.StructType.fromDDL(f"base {span}, spans {span}").fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(1 + 2 * len(KINDS))
        own.p = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            based = [base_spans(t) for t in texts]
            open_ = [i for i, t in enumerate(texts) if _ANCHOR.search(t)]
            full = list(based)
            for i, more in zip(open_, added_spans([texts[i] for i in open_], [based[i] for i in open_], own)):
                full[i] = sorted([*based[i], *more], key=lambda s: (s[0], KINDS.index(s[2])))
            cols = [pa.array([[dict(start=a, end=b, kind=k) for a, b, k in s] for s in x], kind) for x in (based, full)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], names=[*keep, "base", "spans"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, shape)


def masked(text: str, spans: list[Span]) -> str:
    """The text with the name of the kind in place of every span; spans that meet are one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with personal data masked, ``n_chars`` following where it is there.

    All rows stay; null and clean texts stay as they are.  Other columns keep their names and
    values; any names are allowed."""
    tagger = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tagger.p)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    narrow = docs.select(F.struct(*rest, F.lit(0).alias("")).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(1 + 2 * len(KINDS))
        own.p = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            open_ = [i for i, t in enumerate(texts) if t and _ANCHOR.search(t)]
            based = [base_spans(texts[i]) for i in open_]
            for i, base, more in zip(open_, based, added_spans([texts[i] for i in open_], based, own)):
                texts[i] = masked(texts[i], sorted([*base, *more]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.column(1).type)], names=["row", "text"])

    masks = narrow.mapInArrow(run, narrow.schema)
    value = {c: F.col("text") if c == "text" else F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in value:
        value["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masks.select(*[v.alias(c) for c, v in value.items()])


def listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _same(kind: str):
    return lambda c: c == kind


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, fit(docs), ["doc_id"])
    return found.select(
        "doc_id",
        *[F.size(F.filter(F.transform("base", lambda s: s["kind"]), _same(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )

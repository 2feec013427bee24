"""Chat formatting: records of unknown layout to canonical turns, to one marked-up text
with the spans that a model is trained on.

The layout of a record is found by a fingerprint: a hash of those of its nested field
paths that some layout uses.  Each fingerprint selects a declarative mapping.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: marks of the template
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Either single fields with their roles, or a list of messages with two fields."""

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, paths joined by a blank line)
    messages: str = ""
    role: str = ""
    content: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> tuple[str, ...]:
        if self.messages:
            at = f"$.{self.messages}"
            return (at, f"{at}[0].{self.role}", f"{at}[0].{self.content}")
        return tuple(f"$.{p}" for _, ps in self.fields for p in ps)

    def turns(self, record: Column) -> Column:
        if not self.messages:
            text = lambda ps: F.concat_ws("\n\n", *[F.try_variant_get(record, f"$.{p}", "string") for p in ps])
            return F.array(*[F.struct(F.lit(r).alias("role"), text(ps).alias("text")) for r, ps in self.fields])
        found = F.try_variant_get(record, f"$.{self.messages}", f"array<struct<`{self.role}`:string,`{self.content}`:string>>")
        named = lambda c: reduce(lambda e, kv: e.when(c == kv[0], F.lit(kv[1])), self.roles, F.when(F.lit(False), c)).otherwise(c)
        text = lambda m, f: F.coalesce(m[f], F.lit(""))
        system = F.try_variant_get(record, "$.system", "string")
        first = F.when(system.isNotNull(), F.array(F.struct(F.lit("system").alias("role"), system.alias("text")))).otherwise(F.array().cast(TURNS))
        return F.concat(first, F.coalesce(
            F.transform(found, lambda m: F.struct(named(text(m, self.role)).alias("role"), text(m, self.content).alias("text"))),
            F.array().cast(TURNS),
        ))


_SINGLE = (("prompt", "response"), ("prompt", "completion"), ("question", "answer"), ("instruction", "output"), ("input", "output"))
LAYOUTS = (
    Layout("messages", messages="messages", role="role", content="content"),
    Layout("messages_text", messages="messages", role="role", content="text"),
    Layout("from_value", messages="conversations", role="from", content="value", roles=(("human", "user"), ("gpt", "assistant"))),
    *[Layout(f"{a}_{b}", fields=(("user", (a,)), ("assistant", (b,)))) for a, b in _SINGLE],
    *[Layout(f"system_{a}_{b}", fields=(("system", ("system",)), ("user", (a,)), ("assistant", (b,)))) for a, b in _SINGLE],
    Layout("instruction_input_output", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_instruction_input_output", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
)
LISTS = tuple(x for x in LAYOUTS if x.messages)
FIELDS = tuple(x for x in LAYOUTS if not x.messages)
def path_hash(paths) -> int:
    """What ``xxhash64`` gives for the sorted paths, as a signed number."""
    value = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def fingerprint(record: Column, layouts: tuple[Layout, ...]) -> Column:
    """Hash of the nested paths of ``layouts`` that a record (variant) has; other fields do not count."""
    paths = sorted({p for x in layouts for p in x.paths()})
    return F.xxhash64(F.concat_ws("\n", *[F.when(F.try_variant_get(record, p, "variant").isNotNull(), F.lit(p)) for p in paths]))


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``layout`` and ``turns`` (role, text); an unknown layout gives null for both, see ``layout_counts``.

    ``record`` is a variant; for JSON text use ``try_parse_json``.  A null text is empty,
    an empty list has no turns, extra fields are ignored.  A list with messages wins over
    single fields, and a system field beside it is its first turn.
    """
    value = F.col(record)
    marked = records.withColumns({f"_print{k}": fingerprint(value, (x,)) for k, x in enumerate(LISTS)} | {"_print": fingerprint(value, FIELDS)})
    empty = reduce(lambda e, m: e | F.coalesce(F.size(F.try_variant_get(value, f"$.{m}", "array<variant>")) == 0, F.lit(False)), {x.messages for x in LISTS}, F.lit(False))

    def pick(of, none: Column) -> Column:
        found = F.when(F.lit(False), none)
        for k, x in enumerate(LISTS):
            found = found.when(F.col(f"_print{k}") == path_hash(x.paths()), of(x))
        for x in FIELDS:
            found = found.when(F.col("_print") == path_hash(x.paths()), of(x))
        return found.when(empty & (F.col("_print") == path_hash(())), none)

    return marked.withColumns(
        {"layout": pick(lambda x: F.lit(x.name), F.lit("empty")), "turns": pick(lambda x: x.turns(value), F.array().cast(TURNS))}
    ).drop("_print", *[f"_print{k}" for k in range(len(LISTS))])


def layout_counts(chats: DataFrame) -> DataFrame:
    """``layout``, ``count``: records of each layout; the row with a null layout counts those that are lost."""
    return chats.groupBy("layout").count()


def escaped(text: Column) -> Column:
    r"""``\`` after every ``<``, ``[`` and ``\``: no control string that starts with one of
    the first two is left, and dropping the added characters gives the text again."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def formatted(chats: DataFrame, trained: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (start, end in code points) to rows with ``turns``.

    The spans are the texts of the turns of the role ``trained``.
    """
    safe = chats.withColumn(
        "_turns",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(F.coalesce(t["role"], F.lit(""))).alias("r"), escaped(F.coalesce(t["text"], F.lit(""))).alias("t"))),
    )
    marks = len(START) + len(SEP)
    spans = F.aggregate(
        "_turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + marks + F.length(t["r"]) + F.length(t["t"]) + len(END)).alias("at"),
            F.when(
                t["role"] == trained,
                F.concat(
                    a["spans"],
                    F.array(F.struct((a["at"] + marks + F.length(t["r"])).alias("start"), (a["at"] + marks + F.length(t["r"]) + F.length(t["t"])).alias("end"))),
                ),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return safe.withColumns(
        {
            "formatted": F.array_join(F.transform("_turns", lambda t: F.concat(F.lit(START), t["r"], F.lit(SEP), t["t"], F.lit(END))), ""),
            "loss_spans": spans["spans"],
        }
    ).drop("_turns")


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.split(text, "<\\|im_start\\|>", -1)
    body = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(
        body,
        lambda p: F.struct(
            unescaped(F.substring_index(p, SEP, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text"),
        ),
    )


def under_mask(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")


def records_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One ``record`` of the messages layout per conversation of a table with a row per turn.

    Turns are in order, null turns last, equal ones by role and text; rows without a
    conversation make up one of their own.  A conversation is one text, so it is gathered
    as a whole.
    """
    sent = F.struct(F.col(turn).isNull().alias("_late"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    gathered = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(sent)).alias("_m"))
    messages = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return gathered.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def digests(chats: DataFrame) -> DataFrame:
    """What the query returns, read from ``formatted`` and ``loss_spans`` alone."""
    back = chats.select(
        "conv_id", "formatted", read_back(F.col("formatted")).alias("_turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("_loss")
    )
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return digests(formatted(canonical_turns(records_of_rows(rows.unionByName(extra)))))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length('<|im_sep|>') + length('<|im_end|>')
    + length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

"""Chat formatting by perspective rotation: each participant of a conversation in turn is the assistant.

For every participant the dialogue is rendered with that speaker as assistant, the others as named users and system turns as system;
mask spans mark the assistant's words (with the end mark), the only ones to be learned.

A dialogue of PART_TURNS turns or fewer is one row a participant. A longer one comes in parts by turn number, in order, so that no group
grows with a conversation: `part`, and `piece` where a part has more than twice PART_TURNS rows (equal or missing numbers), by turn number and
then dealt by a hash of speaker, text and place in the table. A part in which the participant is silent has an empty mask. `whole` lays parts end to end.

Turns sort by number (null first), speaker and text; equal rows stay. A null role is a participant named `unknown`, a null text is
empty, rows without conv_id form one conversation of their own, a conversation of system turns alone has no participant and no row.
Markers inside texts are escaped with a backslash, in names marks at both ends, backslashes and ends of lines as well. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialise

PART_TURNS = 128
SYSTEM = "system"
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
#: What is replaced in names, in this order.
NAME_ESCAPES = (("\\", "\\\\"), ("<|", "<\\|"), ("|>", "|\\>"), ("\n", "\\n"), ("\r", "\\r"))
MASK = "array<struct<start:int,end:int>>"


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == SYSTEM, F.lit(f"{OPEN}system{CLOSE}\n")).when(role == speaker, F.lit(f"{OPEN}assistant{CLOSE}\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), _name(role), F.lit(f"{CLOSE}\n")))


def _escaped(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit("<\\|"))


def _name(role: Column) -> Column:
    for old, new in NAME_ESCAPES:
        role = F.replace(role, F.lit(old), F.lit(new))
    return role


def _in_pieces(turns: DataFrame, part_turns: int) -> DataFrame:
    """Turns with piece: 0, or in parts with too many rows a number that sorts like the turns do."""
    counts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n")).where(F.col("n") > 2 * part_turns)
    crowded = materialise(counts.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.ceil(F.col("n") / part_turns).cast("long").alias("_n")), "crowded", narrow=True)
    if crowded.isEmpty():
        return turns.withColumn("piece", F.lit(0).cast("long"))
    joined = turns.withColumn("_i", F.monotonically_increasing_id()).join(crowded, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left")
    piece = F.coalesce(F.col("turn").cast("long") - F.col("part") * part_turns, F.lit(-1)) * (1 << 32) + F.pmod(F.xxhash64("role", "text", "_i"), F.col("_n"))
    return joined.select(*turns.columns, F.coalesce(F.when(F.col("_n").isNotNull(), piece), F.lit(0)).cast("long").alias("piece"))


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, piece, n_turns, n_chars, text, mask (array of start and end, in characters of text)."""
    turns = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.floor(F.coalesce(F.col("turn"), F.lit(0)) / part_turns).cast("long").alias("part"),
    )
    turns = _in_pieces(turns, part_turns)
    heads = turns.select("conv_id", "part", "piece", "role")
    speakers = heads.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    parts = heads.select(F.col("conv_id").alias("_c"), "part", "piece").distinct()
    cast = parts.join(speakers, F.col("_c").eqNullSafe(F.col("conv_id"))).select("conv_id", "part", "piece", F.lit(None).cast(turns.select(F.struct("turn", "role", "text")).schema[0].dataType).alias("t"), "speaker")
    # texts are shuffled once: the speakers of the whole conversation come to each part as rows of their own
    rows = turns.select("conv_id", "part", "piece", F.struct("turn", "role", "text").alias("t"), F.lit(None).cast("string").alias("speaker")).unionByName(cast)
    grouped = rows.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list("t")).alias("_turns"), F.sort_array(F.collect_list("speaker")).alias("_speakers"))
    views = grouped.select("conv_id", "part", "piece", "_turns", F.explode("_speakers").alias("speaker"))
    pieces = views.withColumn("_p", F.transform("_turns", lambda t: F.struct(_head(t["role"], F.col("speaker")).alias("head"), F.concat(_escaped(t["text"]), F.lit(END)).alias("body"), (t["role"] == F.col("speaker")).alias("learn"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(MASK).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        return F.struct(end.alias("at"), F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"])), "")
    done = pieces.select("conv_id", "speaker", "part", "piece", F.size("_turns").cast("long").alias("n_turns"), text.alias("text"), F.aggregate("_p", start, step)["spans"].alias("mask"))
    return done.select("conv_id", "speaker", "part", "piece", "n_turns", F.length("text").cast("long").alias("n_chars"), "text", "mask")


def whole(views: DataFrame) -> DataFrame:
    """conv_id, speaker, n_turns, text, mask of whole dialogues, from the parts that `rotate` gives. A dialogue must fit a row here."""
    parts = views.groupBy("conv_id", "speaker").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "n_turns", "n_chars", "text", "mask"))).alias("_p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(MASK).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        moved = F.transform(p["mask"], lambda m: F.struct((m["start"] + acc["at"]).cast("int").alias("start"), (m["end"] + acc["at"]).cast("int").alias("end")))
        return F.struct((acc["at"] + p["n_chars"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    return parts.select("conv_id", "speaker", F.aggregate("_p", F.lit(0).cast("long"), lambda a, p: a + p["n_turns"]).alias("n_turns"), F.array_join(F.col("_p.text"), "").alias("text"), F.aggregate("_p", start, step)["spans"].alias("mask"))


def digest(views: DataFrame) -> DataFrame:
    """The views with the mask as text: start:end, comma-joined."""
    return views.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ","))


def oracle_sql(part_turns: int = PART_TURNS) -> str:
    """digest(rotate()) in plain SQL, for conversations without crowded parts."""
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"
    name = "r"
    for old, new in NAME_ESCAPES:
        name = f"replace({name}, {quoted(old)}, {quoted(new)})"
    return f"""
with t as (select conv_id, turn, coalesce(role, 'unknown') r, coalesce(text, '') x, floor(coalesce(turn, 0) / {part_turns})::bigint part from conversations),
s as (select distinct conv_id c, r speaker from t where r <> '{SYSTEM}'),
v as (select t.*, speaker, case when r = '{SYSTEM}' then {quoted(OPEN + 'system' + CLOSE + chr(10))} when r = speaker then {quoted(OPEN + 'assistant' + CLOSE + chr(10))}
    else '{OPEN}user name=' || {name} || {quoted(CLOSE + chr(10))} end h, replace(x, '{OPEN}', '<\\|') || {quoted(END)} b from t join s on conv_id is not distinct from c),
k as (select *, row_number() over (partition by conv_id, speaker, part order by turn nulls first, r, x) k from v),
o as (select *, (sum(length(h) + length(b)) over (partition by conv_id, speaker, part order by k))::bigint e from k)
select conv_id, speaker, part, 0::bigint piece, count(*) n_turns, sum(length(h) + length(b))::bigint n_chars, string_agg(h || b, '' order by k) as text,
    coalesce(string_agg((e - length(b))::varchar || ':' || e::varchar, ',' order by k) filter (where r = speaker), '') as mask
from o group by conv_id, speaker, part"""

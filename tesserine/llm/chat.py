"""Preference formatting: one prompt and two masked completions per pair of conversations.

The longest common prefix of turns (equal role and text) of the chosen and the rejected
conversation is rendered once as the prompt; what follows in each is its completion. The mask
of a completion says which characters are trained on: the text of assistant turns and its end
marker, not headers and not other roles' turns. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns): the turns of each conversation as an ordered array of role and text.

    Order is by turn, null first, then role and text. Null role and null text count as empty.
    """
    row = F.struct(turns["turn"].alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"))
    grouped = turns.select(turns[key].alias(key), row.alias("__t")).groupBy(key).agg(F.array_sort(F.collect_list("__t")).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{START}', t.role, '\\n', t.text, '{END.strip()}\\n')), '')"


def _mask(turns: str) -> str:
    """Runs of masked (0) and trained (1) characters, as "0*17,1*250"."""
    head = len(START) + len(MIDDLE)
    end = len(END)
    trained = f"concat('0*', {head} + length(t.role), ',1*', length(t.text) + {end})"
    other = f"concat('0*', {head} + length(t.role) + length(t.text) + {end})"
    return f"array_join(transform({turns}, t -> CASE WHEN t.role = '{TRAINED}' THEN {trained} ELSE {other} END), ',')"


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask) of each pair.

    chosen, rejected: ``key``, turn, role, text. A pair that only one side has gets an empty
    other completion, and an empty prompt. Equal conversations are all prompt. Null keys form
    no pair. A pair is one training example, so its turns are held as one row; empty tables
    give no rows.
    """
    sides = [conversations(side.where(side[key].isNotNull()), key).withColumnRenamed("turns", name) for side, name in ((chosen, "c"), (rejected, "r"))]
    both = sides[0].join(sides[1], key, "full")
    empty = "cast(array() AS array<struct<role: string, text: string>>)"
    both = both.select(key, F.expr(f"coalesce(c, {empty})").alias("c"), F.expr(f"coalesce(r, {empty})").alias("r"))
    shorter = "least(size(c), size(r))"
    differs = f"array_position(transform(sequence(0, {shorter}), i -> i >= {shorter} OR get(c, i) <> get(r, i)), true)"
    both = both.withColumn("n_common", F.expr(f"{differs} - 1"))
    after = lambda x: f"slice({x}, int(n_common) + 1, size({x}))"
    return both.select(
        key,
        "n_common",
        F.expr(_rendered("slice(c, 1, int(n_common))")).alias("prompt"),
        F.expr(_rendered(after("c"))).alias("chosen"),
        F.expr(_mask(after("c"))).alias("chosen_mask"),
        F.expr(_rendered(after("r"))).alias("rejected"),
        F.expr(_mask(after("r"))).alias("rejected_mask"),
    )

"""Guides of repositories by an injected model: asked where the pack has changed, again with a short prompt where the reply is of no use, capped and stored by repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.text import extension, lines, normalized_list
from tesserine.operators import models, repos
from tesserine.operators.models import Factory

ASK = "Describe the repository from the numbers and code below only. Reply with JSON: {\"overview\": \"\", \"key_flows\": [], \"entrypoints\": [], \"languages\": [], \"modules\": []}. End statements about code with [path:first-last]."
#: Characters of the overview, key flows, entry points, languages and modules that a guide keeps.
OVERVIEW, FLOWS, ENTRYPOINTS, LANGUAGES, MODULES = 6000, 8, 5, 6, 10
#: Columns of a pack that the digest covers.
PACK = ("languages", "modules", "top_symbols", "top_files", "dir_tree", "entrypoints", "file_heads")
FIELDS = ("overview", "key_flows", "entrypoints", "languages", "modules")
GUIDE = "repo_id string, overview string, key_flows string, entrypoints string, languages array<string>, modules string, pack_sha1 string, updated_at timestamp"
_REPLY = "overview string, key_flows array<string>, entrypoints array<string>, languages array<string>, modules array<string>"


def prompt(files: int = 8, heads: int = 4, head_lines: int = 50, tree_lines: int = 20) -> Column:
    """What the model is asked about a pack (see repos.guide_pack): lists, the first lines of its tree, and of the code of its first files."""
    none = F.array().cast("array<string>")
    named = lambda label, c: F.concat(F.lit(f"\n{label}: "), F.array_join(F.coalesce(c, none), ", "))
    first = lambda text, n: F.array_join(F.slice(lines(F.coalesce(text, F.lit(""))), 1, n), "\n")
    span = lambda h: F.array_join(F.transform(h["span"], lambda x: x.cast("string")), "-")
    shown = F.transform(F.slice("file_heads", 1, heads), lambda h: F.concat(F.lit("\n"), h["rel_path"], F.lit(" ["), span(h), F.lit("]\n```"), extension(h["rel_path"]), F.lit("\n"), first(h["head"], head_lines), F.lit("\n```")))
    whole = F.concat(F.lit(f"{ASK}\n\nRepository: "), "repo_id", named("Languages", F.col("languages")), named("Modules", F.col("modules")), named("Entry points", F.col("entrypoints")), named("Files", F.slice("top_files", 1, files)))
    if tree_lines:
        whole = F.concat(whole, F.lit("\nFolders:\n"), first(F.col("dir_tree"), tree_lines))
    return F.concat(whole, F.coalesce(F.array_join(shown, "\n"), F.lit("")))


def digest(packs: DataFrame) -> Column:
    """SHA-1 of a pack; it changes with any of its columns."""
    return F.sha1(F.to_json(F.struct(*[c for c in PACK if c in packs.columns])).cast("binary"))


def written(packs: DataFrame, stored: DataFrame, factory: Factory, now: Column, attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """The guides to store, with lane and error: ``full`` or ``compact`` by the prompt that was answered, ``failed`` (nothing to store) where neither was.

    packs: repo_id and the columns of repos.guide_pack. stored: repo_id, pack_sha1, ...; a
    repository whose pack has that digest isn't asked again. Where the reply lists no languages or
    modules, those of the pack stay. Packs without a repo_id are left out; no packs, no rows.
    """
    rows = packs.where("repo_id IS NOT NULL").withColumn("pack_sha1", digest(packs))
    new = repos.changed(rows, stored, ["repo_id"], "pack_sha1")
    asked = new.withColumn("full", prompt()).withColumn("compact", prompt(files=6, heads=3, head_lines=30, tree_lines=0))
    asked = models.ask_json(asked.select("repo_id", "pack_sha1", "full", "compact", F.col("languages").alias("pack_languages"), F.col("modules").alias("pack_modules")), factory, ["full", "compact"], "overview", attempts, wait)
    g = F.from_json("reply", _REPLY)
    rows = asked.withColumn("g", g)
    some = lambda given, most: F.slice(normalized_list(F.col(f"g.{given}")), 1, most)
    or_pack = lambda name, most: F.slice(F.when(F.size(normalized_list(F.col(f"g.{name}"))) > 0, normalized_list(F.col(f"g.{name}"))).otherwise(normalized_list(F.col(f"pack_{name}"))), 1, most)
    answered = F.col("step").isNotNull()
    kept = lambda c, name: F.when(answered, c).alias(name)
    return rows.select(
        "repo_id", F.coalesce(F.when(F.col("step") == 1, F.lit("full")).when(F.col("step") == 2, F.lit("compact")), F.lit("failed")).alias("lane"), kept(F.substring("g.overview", 1, OVERVIEW), "overview"),
        kept(F.array_join(F.transform(some("key_flows", FLOWS), lambda x: F.concat(F.lit("- "), x)), "\n"), "key_flows"), kept(F.array_join(some("entrypoints", ENTRYPOINTS), ", "), "entrypoints"), kept(or_pack("languages", LANGUAGES), "languages"),
        kept(F.array_join(or_pack("modules", MODULES), ", "), "modules"), "pack_sha1", now.alias("updated_at"), "error",
    )


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored guides with the new ones in place of theirs; a failed one leaves what is stored."""
    good = new.where("lane <> 'failed'").select(*[c.split()[0] for c in GUIDE.split(", ")])
    return stored.join(good.select("repo_id"), "repo_id", "left_anti").select(*good.columns).unionByName(good)


def fetched(wanted: DataFrame, guides: DataFrame) -> DataFrame:
    """(the columns of wanted, found, and the guide's fields): the guide of each repo_id asked for; texts of a missing one are empty and its list has no items. A null repo_id finds none."""
    held = guides.select("repo_id", *[F.col(f) for f in FIELDS], F.lit(True).alias("found"))
    out = wanted.drop("found", *FIELDS).join(held, "repo_id", "left")
    filled = [F.coalesce(f, F.array().cast("array<string>") if f == "languages" else F.lit("")).alias(f) for f in FIELDS]
    return out.select(*[c for c in wanted.columns if c not in ("found", *FIELDS)], F.coalesce("found", F.lit(False)).alias("found"), *filled)

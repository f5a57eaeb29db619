"""Secrets in texts, and who owns them: a value that many owners hold is a copied example, one of a single owner looks live.

Spans come from built-in regular expressions; only hashes of the values found travel. No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen.llm.folders import written
from alloyscreen.llm.native import let, total

#: Kinds in the order of their output: pattern, group of the value, least characters of the value (fixed values). The patterns of access and hex
#: hold the least length, which finds the same runs as dropping shorter matches: a run is matched from its start, as a whole.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
NAMES = [k[0] for k in KINDS] + ["live", "copied"]


def found(text: Column, number: int) -> Column:
    """The matches of a kind, in order: start, kind, end (code points, end exclusive), from (start of the value), h (hash of the value)."""
    _, pattern, group, least = KINDS[number]
    regex = F.lit(pattern)

    def placed(x: Column) -> Column:
        matches, values = x["matches"], x["values"]
        # a match begins after the gaps up to it and the matches before it
        steps = F.transform(matches, lambda m, i: (F.char_length(F.get(x["gaps"], i)) + F.when(i > 0, F.char_length(F.get(matches, i - 1))).otherwise(0)).cast("long"))
        starts = lambda s: F.transform(matches, lambda m, i: total(F.slice(s, 1, i + 1)))
        each = let(let(steps, starts), lambda at: F.transform(matches, lambda m, i: F.struct(
            F.get(at, i).alias("start"), F.lit(number).alias("kind"), (F.get(at, i) + F.char_length(m)).alias("end"),
            (F.get(at, i) + F.char_length(m) - F.char_length(F.get(values, i))).alias("from"), F.xxhash64(F.get(values, i)).alias("h"),
            F.char_length(F.get(values, i)).alias("size"))))
        return F.filter(each, lambda s: s["size"] >= least)

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, regex, F.lit(0)).alias("matches"), F.regexp_extract_all(text, regex, F.lit(group)).alias("values"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,from:bigint,h:bigint,size:int>>")
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(empty)


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, copied_owners: int = 3, id_column: str = "doc_id", text_column: str = "text", owner_column: str = "source") -> DataFrame:
    """doc_id, row (hash of id and text), n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied and ``found``, the spans as an array of
    (start, kind, end), kind being the place in ``NAMES``.

    Besides the three kinds each value found is a span of its own: ``copied`` if documents of at least ``copied_owners`` owners hold it, else
    ``live``. ``n_live`` and ``n_copied`` count them. Documents are repositories, ``owner_column`` names the owner; a null owner is none.
    A text is scanned once; hashes of its values are counted per owner before they meet, and only documents with a value take part
    in the join. A null text counts as empty. Repeated rows and null ids keep their own row each."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    own = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).alias("row"), F.col(f"`{owner_column}`").cast("string").alias("owner"),
        F.monotonically_increasing_id().alias("place"), *[found(text, k).alias(f"k{k}") for k in range(len(KINDS))],
    )
    own = written(own.select("doc_id", "row", "owner", "place", F.array_sort(F.concat(*[f"k{k}" for k in range(len(KINDS))])).alias("base")), "spans")
    values = own.where(F.size("base") > 0).select("place", "owner", F.explode(F.array_distinct(F.transform("base", lambda s: s["h"]))).alias("h"))
    owners = values.groupBy("h", "owner").agg(F.count("*").alias("repositories")).groupBy("h").agg(F.count("owner").alias("owners"), F.sum("repositories").alias("repositories"))
    shared = owners.where(F.col("owners") >= copied_owners).select("h", "repositories")
    copied = values.select("place", "h").join(shared, "h").groupBy("place").agg(F.collect_list("h").alias("copied"))
    named = own.join(copied, "place", "left").withColumn("copied", F.coalesce("copied", F.array().cast("array<bigint>")))
    owned = F.transform("base", lambda s: F.struct(s["from"].alias("start"), F.when(F.array_contains("copied", s["h"]), 4).otherwise(3).alias("kind"), s["end"].alias("end")))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    named = named.select("doc_id", "row", plain.alias("base"), F.array_sort(F.array_distinct(F.concat(plain, owned))).alias("found"))
    count = lambda column, kind: F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")
    return named.select(
        "doc_id", "row", *[count("base", k).alias(f"n_{name[0]}") for k, name in enumerate(KINDS)], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.col("found")).alias("spans"), count("found", 3).alias("n_live"), count("found", 4).alias("n_copied"), "found",
    )


def masked(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each stretch that spans cover replaced by ``mark``; spans are in order of their start."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        new = F.when(x["start"] >= s["at"], F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), new.alias("out"))

    return F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text))))

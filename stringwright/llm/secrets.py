"""Secret scans: certain patterns, and weak candidates that complementary parts nearby confirm.

Only DataFrame functions. Positions come from the texts between matches: a split by a pattern and the
list of its matches alternate, so running lengths give every start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwright.llm.store import settle

# The base kinds in order, their patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
BASE = ("assign", "access", "hex")

#: Weak parts, after the base kinds: user or key names, key-like words, and places to use them at.
#: Each kind has the word that a text must contain (in lower case) to be searched at all.
WEAK = {
    "identifier": (r"((?i:user(?:name)?|login|account|client_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,})", ("user", "login", "account", "clientid", "client_id", "keyid", "key_id")),
    "key": (r"((?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+(?![A-Za-z0-9+/_-]))", ()),
    "endpoint": (r"((?i:https?|ftp|ssh|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x00-\x20\"'<>]+)", ("://",)),
}
KINDS = (*BASE, *WEAK)
#: What each kind is a part of, for linking.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "key": "secret", "endpoint": "endpoint"}
#: Matches that are given their places together.
CHUNK = 256
#: Characters between parts that still belong to one scope.
SCOPE = 200


def _found(text: Column, kind: str, pattern: str, least: tuple[int, int] | None = None) -> Column:
    """Array of (kind, start, end) of the matches of ``pattern``, whose group 1 is all of it.

    ``least`` (group, length) drops matches whose group is shorter.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), 1)
    between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    lengths = F.transform(matches, lambda s: F.length(s))
    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + pair["size"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"))
        out = F.when(pair["good"], F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    if least is None:
        good = F.transform(matches, lambda s: F.lit(True))
    elif least[0] == 1:
        good = F.transform(matches, lambda s: F.length(s) >= least[1])
    else:
        good = F.transform(F.regexp_extract_all(text, F.lit(pattern), least[0]), lambda s: F.length(s) >= least[1])
    pairs = F.transform(
        F.arrays_zip(lengths.alias("size"), F.slice(between, F.lit(1), F.size(matches)).alias("gap"), good.alias("good")),
        lambda z: F.struct(z["size"].alias("size"), z["gap"].alias("gap"), z["good"].alias("good")),
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    # a fold copies what it has found at every match, so matches are folded by chunks, each from where it starts
    def folded(x: Column) -> Column:
        chunk = lambda c: F.slice(x["pairs"], c * CHUNK + 1, CHUNK)
        chunks = F.sequence(F.lit(0), F.floor(F.size(x["pairs"]) / CHUNK).cast("int"))
        sizes = F.transform(chunks, lambda c: F.aggregate(chunk(c), F.lit(0), lambda n, p: n + p["gap"] + p["size"]))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda found, n: F.array_append(found, F.element_at(found, -1) + n))
        begun = F.arrays_zip(chunks.alias("c"), F.slice(starts, F.lit(1), F.size(chunks)).alias("at"))
        begin = lambda z: F.struct(z["at"].alias("at"), none.alias("out"))
        return F.flatten(F.transform(begun, lambda z: F.aggregate(chunk(z["c"]), begin(z), step, lambda s: s["out"])))

    return F.transform(F.array(F.struct(pairs.alias("pairs"))), folded)[0]


def _searched(text: Column, needed: list[Column], spans: Column) -> Column:
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    condition = F.lit(False)
    for c in needed:
        condition = condition | c
    return F.when(condition, spans).otherwise(none) if needed else spans


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, row (unique), base and weak: arrays of (kind, start, end), code points, end exclusive."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(text)
    words = lambda *ws: [F.contains(low, F.lit(w)) for w in ws]
    base = F.concat(
        _searched(text, words("password", "passwd", "secret", "token", "apikey", "api_key"), _found(text, "assign", ASSIGN, (2, ASSIGN_LEAST))),
        _searched(text, [F.contains(text, F.lit("AKIA"))], _found(text, "access", ACCESS, (1, ACCESS_LEAST))),
        _searched(text, [F.rlike(text, F.lit(HEX))], _found(text, "hex", HEX)),
    )
    weak = F.concat(
        *[
            _searched(text, words(*needed) if needed else [F.rlike(text, F.lit("[A-Za-z0-9+/_-]{32}"))], _found(text, kind, pattern))
            for kind, (pattern, needed) in WEAK.items()
        ]
    )
    return docs.select(F.col("doc_id"), base.alias("base"), weak.alias("weak"))


def linked(found: DataFrame) -> DataFrame:
    """row, spans: the weak parts with a complementary part within ``SCOPE`` characters.

    An interval join: parts fall into cells of ``SCOPE`` characters; a part within reach of another
    lies in its own or a neighbouring cell, where the nearest is the last or first of its role. So
    each weak part meets at most three rows per role, however many parts a text has. A weak secret
    needs an identifier or an endpoint; a weak identifier or endpoint needs a secret.
    """
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), F.col("part.kind"))
    each = found.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("part"))
    each = each.withColumn("role", role).withColumn("cell", F.floor(F.col("part.start") / SCOPE).cast("int"))
    # a long part is known in every cell it touches
    last = F.floor((F.col("part.end") - 1) / SCOPE).cast("int")
    known = each.withColumn("cell", F.explode(F.sequence("cell", last)))
    known = known.groupBy("row", "role", "cell").agg(
        F.min(F.greatest("part.start", F.col("cell") * SCOPE)).alias("from"),
        F.max(F.least("part.end", (F.col("cell") + 1) * SCOPE)).alias("to"),
    ).withColumnRenamed("role", "other").withColumnRenamed("cell", "there")
    weak = each.where(F.col("part.kind").isin(*WEAK))
    weak = weak.withColumn("there", F.explode(F.sequence(F.col("cell") - 1, F.floor((F.col("part.end") - 1) / SCOPE).cast("int") + 1)))
    met = weak.join(known, ["row", "there"]).where("(role = 'secret') <> (other = 'secret')")
    near = (F.col("from") < F.col("part.end") + SCOPE) & (F.col("to") > F.col("part.start") - SCOPE)
    return met.where(near).groupBy("row").agg(F.collect_set("part").alias("spans"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans (kind, start, end) for every row of ``docs`` (doc_id, text).

    Base kinds are always reported; weak ones only where parts of another role lie near them and no
    base span overlaps. Null and empty texts have no spans; a null doc_id is passed on; repeated rows
    are answered each, an empty table gives no rows; other columns are ignored.
    """
    found = parts(docs.select("doc_id", "text"))
    found = settle(found.withColumn("row", F.when(F.size("weak") > 0, F.md5(F.to_json(F.struct("doc_id", "base", "weak"))))), "parts")
    # equal rows have equal parts: one answer serves them all
    distinct = found.where("row IS NOT NULL").dropDuplicates(["row"])
    links = linked(distinct)
    both = found.join(links, "row", "left")
    free = F.filter(
        F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int>>")),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return both.select("doc_id", "base", free.alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``secrets``; the base spans as a hash."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        order = F.array(*[F.lit(k) for k in KINDS])
        keyed = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]), s["end"], s["kind"].alias("kind")))
        return F.array_join(
            F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )

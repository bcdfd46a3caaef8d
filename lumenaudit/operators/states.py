"""What the rules ask of an audit's pages, as states that pages can be added to and taken out of.

A fact (`Fact`) is declared once and gives both the aggregate of a full run and its state: sums and counts stay what they
are, with a sign; a flag is a count of the pages that raise it, a set of bits a count per bit; what can't be undone by a
subtraction (distinct titles, the newest date, links to a page) is a multiset of keys with counts. So states are two
tables, of counters (a row per audit) and of keys (a row per audit, kind and key), and two states merge by adding up:
of disjoint pages, of a state and a change, of a change that takes out a page's old signals and adds its new ones.

A store of states is a log. A change is appended in buckets by audit; reading the states of the audits that a change
touches reads their buckets, never pages, and `compact` folds the log. So new or changed pages cost in proportion to
themselves and to the audits they belong to.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UNITS, units

C = F.col
#: Parts of a log, by audit.
BUCKETS = 64
KEYS = "audit_id string, kind string, key string, n bigint"


@dataclass(frozen=True)
class Fact:
    """sum (of integers), share (a sum of doubles in integers of 2^-50), count and any (of a condition), bits (of conditions), newest (of dates)."""

    kind: str
    value: Column | tuple[Column, ...]

    def aggregate(self) -> Column:
        """Over all pages of an audit at once."""
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "share":
            return F.sum(units(self.value)).cast("double") / UNITS
        if self.kind == "count":
            return F.count_if(self.value)
        if self.kind == "any":
            return F.coalesce(F.bool_or(self.value), F.lit(False))
        if self.kind == "bits":
            # Unlike sets and texts, bits keep the grouping in its fast, fixed-width form.
            return F.bit_or(reduce(lambda a, b: a + b, (F.when(c, 1 << k).otherwise(0) for k, c in enumerate(self.value))))
        return F.max(self.value)

    def counters(self, name: str) -> dict[str, Column]:
        """A page's part of each counter; null counts as nothing."""
        if self.kind == "sum":
            return {name: F.coalesce(self.value.cast("long"), F.lit(0)), f"{name}:n": self.value.isNotNull().cast("long")}
        if self.kind == "share":
            return {name: F.coalesce(units(self.value).cast("long"), F.lit(0)), f"{name}:n": self.value.isNotNull().cast("long")}
        if self.kind == "newest":
            return {}
        flags = self.value if self.kind == "bits" else (self.value,)
        return {f"{name}:{k}" if self.kind == "bits" else name: F.coalesce(c, F.lit(False)).cast("long") for k, c in enumerate(flags)}

    def restored(self, name: str) -> Column:
        """What `aggregate` gives, from the counters."""
        at = lambda n: C(f"`{n}`")
        if self.kind in ("sum", "share"):
            whole = at(name).cast("long") if self.kind == "sum" else at(name).cast("double") / UNITS
            return F.when(at(f"{name}:n") > 0, whole)
        if self.kind == "any":
            return F.coalesce(at(name) > 0, F.lit(False))
        if self.kind == "bits":
            return reduce(lambda a, b: a + b, (F.when(at(f"{name}:{k}") > 0, 1 << k).otherwise(0) for k in range(len(self.value))))
        return at(name)


def total(c: Column) -> Fact:
    return Fact("sum", c)


def shares(c: Column) -> Fact:
    return Fact("share", c)


def count(c: Column) -> Fact:
    return Fact("count", c)


def any_page(c: Column) -> Fact:
    return Fact("any", c)


def bits(c: str, names: tuple[str, ...]) -> Fact:
    """The names of a fixed list that any page's array has."""
    return Fact("bits", tuple(F.array_contains(c, n) for n in names))


def newest(c: Column) -> Fact:
    return Fact("newest", c)


@dataclass(frozen=True)
class State:
    """counters(audit_id, pages, ...) and keys(audit_id, kind, key, n); both add up."""

    counters: DataFrame
    keys: DataFrame

    def merged(self, *others: State) -> State:
        """The sum of states. Keys that come to nothing go; an audit without pages keeps its row of zeros."""
        every = (self, *others)
        names = [c for c in self.counters.columns if c != "audit_id"]
        counters = reduce(DataFrame.unionByName, (s.counters for s in every)).groupBy("audit_id").agg(*(F.sum(C(f"`{n}`")).cast(self.counters.schema[n].dataType).alias(n) for n in names))
        keys = reduce(DataFrame.unionByName, (s.keys for s in every)).groupBy("audit_id", "kind", "key").agg(F.sum("n").alias("n")).where("n <> 0")
        return State(counters, keys)

    def of(self, audits: DataFrame) -> State:
        """The states of audits(audit_id)."""
        own = audits.select("audit_id").distinct()
        return State(self.counters.join(own, "audit_id", "left_semi"), self.keys.join(own, "audit_id", "left_semi"))


def title_key() -> Column:
    """What two pages with the same title share; null for pages without one."""
    return F.when(F.trim("title") != "", F.lower(F.trim("title")))


CONTRIBUTION = "c array<bigint>, k array<struct<kind:string,key:string>>"


def _parts(facts: dict[str, Fact]) -> dict[str, Column]:
    return {n: c for name, f in sorted(facts.items()) for n, c in f.counters(name).items()}


def contributions(pages: DataFrame, facts: dict[str, Fact], inputs: dict[str, Column]) -> DataFrame:
    """pages (schema.PAGE_SIGNALS) with `contribution`: what each adds to its audit's counters, in order of their names, and its keys."""
    dates = [f.value for f in facts.values() if f.kind == "newest"]
    kinds = [F.struct(F.lit("page").alias("kind"), C("url").alias("key")), F.struct(F.lit("title").alias("kind"), title_key().alias("key")), *(F.struct(F.lit("date").alias("kind"), d.cast("string").alias("key")) for d in dates)]
    # A page counts once for each page that it links to, however often it does.
    links = F.transform(F.array_distinct(F.coalesce("internal_link_targets", F.array().cast("array<string>"))), lambda u: F.struct(F.lit("link").alias("kind"), u.alias("key")))
    keys = F.filter(F.concat(F.array(*kinds), links), lambda k: k["key"].isNotNull())
    made = pages.withColumns({n: c.cast("double") for n, c in inputs.items()})
    return made.withColumn("contribution", F.struct(F.array(*(c.cast("bigint") for c in _parts(facts).values())).alias("c"), keys.alias("k"))).drop(*inputs)


def summed(changes: DataFrame, facts: dict[str, Fact]) -> State:
    """The state of changes(audit_id, sign, contribution)."""
    signed = lambda c: F.sum(c * C("sign")).cast("decimal(38,0)")
    # Decimals, so that no sum of an audit can overflow.
    each = [signed(F.get("contribution.c", F.lit(k)).cast("decimal(19,0)")).alias(n) for k, n in enumerate(_parts(facts))]
    counters = changes.groupBy("audit_id").agg(F.sum(C("sign")).cast("decimal(38,0)").alias("pages"), *each)
    keys = changes.select("audit_id", "sign", F.explode("contribution.k").alias("k")).groupBy("audit_id", "k.kind", "k.key").agg(F.sum("sign").cast("long").alias("n")).where("n <> 0")
    return State(counters, keys)


def state(pages: DataFrame, facts: dict[str, Fact], inputs: dict[str, Column], sign: Column | int = 1) -> State:
    """The state of pages (schema.PAGE_SIGNALS), each with a sign: 1 to add it, -1 to take it out."""
    return summed(contributions(pages, facts, inputs).withColumn("sign", sign if isinstance(sign, Column) else F.lit(sign)), facts)


def change(before: DataFrame, after: DataFrame, facts: dict[str, Fact], inputs: dict[str, Column]) -> State:
    """The change from pages as they were to the same pages as they are; new pages stand in `after` alone, lost ones in `before`."""
    both = before.withColumn("__way", F.lit(-1)).unionByName(after.withColumn("__way", F.lit(1)))
    return state(both, facts, inputs, C("__way"))


def facts_of(s: State, facts: dict[str, Fact]) -> DataFrame:
    """One row per audit with pages: what `rules.facts` gives for the pages that are in the state."""
    there = s.keys.where("n > 0")
    home = F.min(F.when(C("kind") == "page", C("key"))).alias("home")
    sums = there.groupBy("audit_id").agg(
        F.coalesce(F.sum(F.when(C("kind") == "title", C("n"))), F.lit(0)).alias("titled"),
        F.count_if(C("kind") == "title").alias("distinct_titles"),
        F.max(F.when(C("kind") == "date", C("key"))).cast("date").alias("__newest"),
        home,
    )
    links = there.where("kind = 'link'").select("audit_id", "key")
    lost = there.where("kind = 'page'").join(links, ["audit_id", "key"], "left_anti").join(sums.select("audit_id", "home"), "audit_id").where("key <> home").groupBy("audit_id").agg(F.sum("n").cast("long").alias("orphans"))
    known = s.counters.where("pages > 0").join(sums.drop("home"), "audit_id", "left").join(lost, "audit_id", "left").fillna(0, ["titled", "distinct_titles", "orphans"])
    restored = [C("__newest").alias(n) if f.kind == "newest" else f.restored(n).alias(n) for n, f in sorted(facts.items())]
    return known.select("audit_id", C("pages").cast("long").alias("pages"), *restored, "titled", "distinct_titles", "orphans")


# --- a log of states


def append(path: str, s: State, batch: str) -> None:
    """Adds a change to the log. A batch that is appended again replaces itself, so it counts once."""
    bucket = F.pmod(F.xxhash64("audit_id"), F.lit(BUCKETS)).cast("int")
    for name, df in (("counters", s.counters), ("keys", s.keys)):
        df.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path.rstrip('/')}/{name}/batch={batch}")


def read(spark: SparkSession, path: str, audits: DataFrame | None = None) -> State:
    """The sum of the log: of all audits, or of those of audits(audit_id), from their buckets alone."""
    base = path.rstrip("/")
    own = None if audits is None else sorted(r[0] for r in audits.select(F.pmod(F.xxhash64("audit_id"), F.lit(BUCKETS)).cast("int")).distinct().collect())  # BUCKETS numbers at most

    def part(name: str) -> DataFrame:
        df = spark.read.parquet(f"{base}/{name}")
        return (df if own is None else df.where(C("bucket").isin(own))).drop("bucket", "batch")

    found = State(part("counters"), part("keys"))
    return (found if audits is None else found.of(audits)).merged()


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Writes the sum of the log as the one batch of a new log."""
    append(to, read(spark, path), "0")

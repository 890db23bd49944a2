"""Document fingerprints by SpotSigs, in DataFrame operations only.

A spot is a common word (an anchor) and the `chain` content words that follow it, other common
words skipped within `reach` words; its signature is a 64-bit hash. A text's fingerprint is the set
of its signatures. A text without any spot has one signature, of all its words. Sets are compared
by their Jaccard likeness; sets whose lengths alone keep it under a threshold are pruned.

`similar_groups` (for groups) and `similar_classes` (for all pairs) join all fingerprints: equal sets are one class; signatures
are looked up rarest first, and only as many of them as a likeness over the threshold must share, fewer for the smaller set;
classes meet in the partitions of their set length and the next, and a pair is compared where both lie in one partition. A
signature that many classes look up is dealt over cells of CELL classes a side, so that no task gets all of them.

Cases: a null text counts as empty; a text without words has one signature, that of no words.
Equal texts have equal fingerprints; so have texts that differ in case or punctuation only. Each row
is a document, also if it repeats an id; in `with_next`, rows of one id follow in the order of their
texts, and null ids come first, in the order of a hash of their texts. Words are runs of letters and digits, whatever
their script. Texts of any length are read whole. An empty table gives no rows. All columns of the results are made here, so
that other columns never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import forget, q, written
from gleaner.llm.components import components

# Frequent function words of English, French, German and Spanish.
ANCHORS = (
    "a an the is are was were be to of and in that this with for by on it as from or at not but have has had "
    "le la les de des du un une et en est que qui dans pour sur par au aux pas plus ce "
    "der die das und ist ein eine den dem von zu mit nicht sich auf für im als auch es "
    "el los las y del se por con para su una al lo como más o"
).split()
CHAIN = 2
REACH = 8
ROWS_PER_BUCKET = 4096
MAX_BUCKETS = 1 << 16
CELL = 1 << 10
LEAST = 0.8
ROUNDS = 2  # of comparing with hubs before the rest is compared
FAN = 16
TRIES = 4


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN, reach: int = REACH) -> Column:
    """The sorted distinct signatures of a text.

    The text becomes ' word word ...' with anchors marked by a leading '|' (a hash lookup a word); a pattern
    with a look-ahead then finds the chains, also those that overlap, in one pass."""
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    marked = F.array_join(F.transform(F.split(flat, " "), lambda w: F.when(w.isin(sorted(set(anchors))), F.concat(F.lit("|"), w)).otherwise(w)), " ")
    skip = rf"(?:\|[^ ]+ ){{0,{reach}}}"
    spot = rf"(?=(\|[^ ]+ (?:{skip}[^ |]+ ){{{chain}}}))\|"
    found = F.regexp_extract_all(marked, F.lit(spot), F.lit(1))
    # the anchor itself stays, common words between the content words go
    plain = F.transform(found, lambda s: F.xxhash64(F.concat(F.substring_index(s, " ", 1), F.regexp_replace(F.substr(s, F.locate(" ", s)), r"\|[^ ]+ ", ""))))
    return F.array_sort(F.array_distinct(F.when(F.size(plain) > 0, plain).otherwise(F.array(F.xxhash64(flat)))))


def digest(sigs: Column) -> Column:
    """A fingerprint as text: how many signatures, and a hash of them in order."""
    return F.concat_ws(":", F.lower(F.hex(F.size(sigs))), F.substring(F.sha2(F.array_join(sigs, ","), 256), 1, 40))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets; 0 where their lengths keep it under `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(small < F.lit(least) * large, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, sigs, next_text, next_sigs: each text and that of the next document in ascending id, the
    last's being the first's. Texts are shuffled once; signatures are made once, behind that shuffle.

    Ids are cut into ranges of about ROWS_PER_BUCKET rows by approximate quantiles (of more than MAX_BUCKETS times that,
    larger ones); a row finds its range by a binary search. A range looks up its followers by itself, and the first
    row of each range is also handed to the range before."""
    docs = docs.select(q(id_col).cast("long").alias("doc_id"), F.coalesce(q(text_col), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))  # null ids spread over ranges of their own
    n = docs.count()
    buckets = max(1, min(MAX_BUCKETS, math.ceil(n / ROWS_PER_BUCKET)))
    cuts = []
    if buckets > 1:
        cuts = sorted(set(docs.select(key.alias("k")).agg(F.percentile_approx("k", [k / buckets for k in range(1, buckets)], 20 * buckets)).first()[0]))
    table, steps = F.lit(cuts).cast("array<long>"), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    under = lambda at, step: F.coalesce(F.get(table, at + step - 1) < key, F.lit(False))
    bucket = F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), lambda at, step: F.when(under(at, step), at + step).otherwise(at)) if cuts else F.lit(0)
    rows = docs.withColumns({"k": key, "bucket": bucket, "last": F.lit(0)})
    first = rows.groupBy("bucket").agg(F.min(F.struct("k", "text")).alias("f")).select("bucket", "f.k", "f.text")
    first = written(first, "range-starts")  # one text a range
    used = [r.bucket for r in first.select("bucket").orderBy("bucket").collect()]  # at most `buckets` numbers
    before = {b: used[k - 1] for k, b in enumerate(used)}
    back = docs.sparkSession.createDataFrame(list(before.items()), "bucket int, back int")
    heads = first.join(F.broadcast(back), "bucket").select(F.lit(None).cast("long").alias("doc_id"), "text", "k", F.col("back").alias("bucket"), F.lit(1).alias("last"))
    order = W.partitionBy("bucket").orderBy("last", "k", "text")
    rows = rows.unionByName(heads).withColumn("next_text", F.lead("text").over(order))
    rows = rows.withColumn("sigs", signatures(F.col("text"))).withColumn("next_sigs", F.lead("sigs").over(order))
    return rows.filter("last = 0").select("doc_id", "text", "sigs", "next_text", "next_sigs")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text's signatures, its edited text's (the last quarter replaced by as much of the next
    document) and the next document's: doc_id, text, edited_text, sigs, edited_sigs, next_sigs."""
    rows = with_next(docs, id_col, text_col)
    cut = F.floor(F.length("text") / 4).cast("int")
    change = F.concat(F.substr("text", F.lit(1), F.length("text") - cut), F.substr("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited_text", change)
    return rows.select("doc_id", "text", "edited_text", "sigs", signatures(F.col("edited_text")).alias("edited_sigs"), "next_sigs")


def _set_classes(prints: DataFrame, sigs_col: str) -> DataFrame:
    """class (a hash of the set), sigs, n of each different set."""
    classes = prints.select(F.xxhash64(sigs_col).alias("class"), F.col(sigs_col).alias("sigs")).groupBy("class").agg(F.any_value("sigs").alias("sigs"))
    return written(classes.withColumn("n", F.size("sigs")), "signature-classes")


def _prefixes(classes: DataFrame, t: float) -> DataFrame:
    """class, n, sig, pos, seen, part, short: the signatures under which a class is looked up, rarest first, where in that
    order they stand, how many classes have them, the partition of the set's length, and whether the smaller of two sets needs them.

    The larger of two sets shares one of its n - ceil(t n) + 1 rarest signatures, the smaller one of its
    n - ceil(2 t / (1 + t) n) + 1; those of one class only come first and find nothing."""
    spread = classes.select("class", "n", F.explode("sigs").alias("sig"))
    seen = written(spread.groupBy("sig").agg(F.count("*").alias("seen")).filter("seen > 1"), "shared-signatures")
    ranked = spread.join(seen, "sig").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "sig"))).alias("order"))
    alone = F.col("n") - F.size("order")
    prefix = F.transform(F.slice("order", F.lit(1), F.greatest(F.size("order") - F.ceil(F.col("n") * t).cast("int") + 1, F.lit(0))), lambda s, k: F.struct(s["seen"].alias("seen"), s["sig"].alias("sig"), (alone + k).alias("pos")))
    prefix = ranked.select("class", "n", F.explode(prefix).alias("s"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(t))).cast("int")
    short = F.col("s.pos") <= F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)))
    out = written(prefix.select("class", "n", "s.sig", "s.pos", "s.seen", part.alias("part"), short.alias("short")), "prefixes")
    forget(seen)
    return out


def _may_be_close(t: float) -> Column:
    """Whether, by lengths and by what is left of both behind a shared signature, sets a and b can be alike."""
    near = F.least("n_a", "n_b") >= F.lit(t) * F.greatest("n_a", "n_b")
    return near & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= F.lit(t / (1 + t)) * (F.col("n_a") + F.col("n_b")))


def _alike(pairs: DataFrame, classes: DataFrame, least: float, label: str) -> DataFrame:
    """class_a, class_b, likeness of those pairs whose sets are at least so alike."""
    sets = classes.select("class", "sigs")
    pairs = pairs.join(sets.toDF("class_a", "a"), "class_a").join(sets.toDF("class_b", "b"), "class_b")
    pairs = pairs.withColumn("likeness", likeness(F.col("a"), F.col("b"), least - 1e-9)).filter(F.col("likeness") >= least - 1e-12)
    return written(pairs.select("class_a", "class_b", "likeness"), label)


def similar_classes(prints: DataFrame, least: float = LEAST, sigs_col: str = "sigs", cell: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs) of a table of signature sets: class (a hash of the set) and links, how many other classes are at least
    `least` like it; and all those pairs, class_a < class_b, likeness. As many pairs as there are: of a large group of near
    copies the square of its size. `similar_groups` joins such groups without their pairs."""
    cell = cell or CELL
    classes = _set_classes(prints, sigs_col)
    t = least - 1e-9  # a hair less than `least`, as n times it is rounded
    prefix = _prefixes(classes, t).withColumn("chunks", F.ceil(F.col("seen") / cell).cast("int"))
    own = F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")
    left = prefix.filter("short").select(F.col("class").alias("class_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), "sig", "part", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    right = prefix.select(F.col("class").alias("class_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), "sig", "part", "chunks", own.alias("j"))
    right = right.select("class_b", "n_b", "pos_b", "sig", "j", "chunks", F.explode(F.array(F.col("part") - 1, F.col("part"))).alias("part"))
    right = right.select("class_b", "n_b", "pos_b", "sig", "j", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"))
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("class_a") < F.col("class_b")))
    pairs = left.join(right, ["sig", "part", "i", "j"]).filter(order & _may_be_close(t))
    pairs = written(pairs.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).distinct(), "signature-pairs")
    pairs = _alike(pairs, classes, least, "similar-classes")
    ends = pairs.select(F.col("class_a").alias("class")).union(pairs.select("class_b")).groupBy("class").agg(F.count("*").alias("links"))
    return classes.select("class").join(ends, "class", "left").withColumn("links", F.coalesce("links", F.lit(0))), pairs


def similar_groups(prints: DataFrame, least: float = LEAST, sigs_col: str = "sigs", cell: int | None = None) -> DataFrame:
    """(class, label) of every class that is at least `least` like another: label is the smallest class that it reaches over
    such links. The groups are those of all pairs of `similar_classes`, but pairs within a group are not all made.

    A bucket is a looked-up signature in a partition of set lengths; it holds the sets of that partition and the next. ROUNDS
    times, buckets fall into parts of about FAN rows, and each class is compared with the TRIES classes that it meets most often
    as hubs of its parts; a hub is of the group that has most rows there. At last, in buckets that still hold several groups, all rows outside the largest group are compared
    with all rows of other groups, in cells of at most `cell` rows a side."""
    return _groups(_set_classes(prints, sigs_col), least, cell or CELL)


def _groups(classes: DataFrame, least: float, cell: int) -> DataFrame:
    """The same of written classes, which are deleted."""
    t = least - 1e-9
    prefix = _prefixes(classes, t)
    at = prefix.select("class", "n", "sig", "pos", "short", F.col("part").alias("of"), F.explode(F.array(F.col("part") - 1, F.col("part"))).alias("part"))
    at = at.select(F.xxhash64("sig", "part").alias("key"), "class", "n", "pos", (F.col("short") & (F.col("of") == F.col("part"))).alias("small"))
    shared = written(at.groupBy("key").agg(F.count("*").alias("rows"), F.max("small").alias("any")).filter("rows > 1 and any").select("key", "rows"), "signature-buckets")
    at = written(at.join(shared, "key"), "bucket-rows")
    forget(prefix, shared)
    row = F.struct("class", "n", "pos", "small")
    first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("class_a") < F.col("class_b")))
    close = F.when(first, F.col("small_a")).otherwise(F.col("small_b")) & _may_be_close(t)
    pair = (F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))
    links, tried, label = None, None, None
    for no in range(ROUNDS + 1):
        last = no == ROUNDS
        now = at.withColumn("label", F.col("class")) if label is None else at.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
        if not last:  # a bucket falls into parts of about FAN rows, others each time
            now = now.withColumn("key", F.xxhash64("key", F.pmod(F.xxhash64("class", F.lit(no)), F.ceil(F.col("rows") / FAN))))
        now = written(now.drop("rows"), "labelled-rows")
        groups = now.groupBy("key", "label").agg(F.count("*").alias("rows"), F.max(row).alias("hub"))
        hubs = groups.groupBy("key").agg(F.max(F.struct("rows", "label", "hub")).alias("top"), F.sum("rows").alias("all"), F.count("*").alias("groups")).filter("groups > 1")
        hubs = written(hubs.select("key", "all", F.col("top.rows").alias("most"), F.col("top.label").alias("top"), "top.hub"), "hubs")
        if last:
            pairs = _other_groups(now, hubs, cell).filter(close).select(*pair).distinct()
        else:
            met = now.join(hubs, "key").filter("label <> top")
            met = met.select(*(F.col(c).alias(f"{c}_a") for c in ("class", "n", "pos", "small")), *(F.col(f"hub.{c}").alias(f"{c}_b") for c in ("class", "n", "pos", "small")))
            met = met.filter(F.least("n_a", "n_b") >= F.lit(t) * F.greatest("n_a", "n_b")).groupBy("class_a", "class_b").agg(F.count("*").alias("times"))
            met = met.groupBy("class_a").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "class_b")), False), 1, TRIES).alias("m"))
            met = met.select("class_a", F.explode("m.class_b").alias("class_b"))
            pairs = met.select(*pair).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["class_a", "class_b"], "left_anti"), "signature-pairs")
        found = _alike(pairs, classes, least, "similar-classes")
        forget(now, hubs)
        links, tried = (found, pairs) if links is None else (links.union(found), tried.union(pairs))
        if label is None or found.limit(1).count():
            label = written(components(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))).toDF("class", "label"), "group-labels")
    forget(at, classes)
    return label


def _other_groups(now: DataFrame, hubs: DataFrame, cell: int) -> DataFrame:
    """The rows of a bucket outside its largest group, each with every row of another group."""
    open_ = now.join(hubs.select("key", "all", "most", "top"), "key")
    open_ = written(open_.withColumns({"is": F.ceil((F.col("all") - F.col("most")) / cell).cast("int"), "js": F.ceil(F.col("all") / cell).cast("int")}), "open-buckets")
    over = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c: F.pmod(F.xxhash64("class"), F.col(c)).cast("int")
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "pos", "small", "label")]
    left = open_.filter("label <> top").select("key", *side("a"), deal("is").alias("i"), over("js").alias("j"))
    right = open_.select("key", *side("b"), deal("js").alias("j"), over("is").alias("i"))
    return left.join(right, ["key", "i", "j"]).filter("label_a <> label_b")


def with_groups(rows: DataFrame, least: float = LEAST, id_col: str = "doc_id", sigs_col: str = "sigs") -> DataFrame:
    """rows less the signatures, with class_id (a hash of them) and group_id: the smallest id that a row reaches over links of
    at least `least`, its own included; null in a group without ids. While groups are found, the signatures are kept once a class
    and no longer with the rows."""
    full = written(rows, "fingerprints")
    classes = _set_classes(full, sigs_col)
    rows = written(full.withColumn("class_id", F.xxhash64(sigs_col)).drop(sigs_col), "rows-of-classes")
    forget(full)
    label = _groups(classes, least, CELL).withColumnRenamed("class", "class_id")
    of = rows.groupBy("class_id").agg(F.min(q(id_col)).alias("first")).join(label, "class_id", "left")
    of = written(of.withColumn("label", F.coalesce("label", "class_id")), "class-labels")
    keep = written(of.groupBy("label").agg(F.min("first").alias("group_id")), "group-ids")
    return rows.join(written(of.join(keep, "label").select("class_id", "group_id"), "class-groups"), "class_id")


def similar_pairs(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id and class of every row, and the pairs of classes whose likeness is at least `least`:
    class_a < class_b, likeness. A class is all rows of equal signatures, named by a hash of them."""
    rows = written(docs.select(q(id_col).alias("doc_id"), signatures(q(text_col)).alias("sigs")), "signatures")
    return rows.select("doc_id", F.xxhash64("sigs").alias("class")), similar_classes(rows, least)[1]

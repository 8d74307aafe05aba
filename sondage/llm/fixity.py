"""Merkle fixity audit of WARC records.

Each replica has a tree of its own over its own records. A leaf stands for records of one
id and one content: it hashes the record's bytes, how many copies there are, their length
and their place, as an offset from the first byte of its node. Nodes divide the ids: the
primary's every ``FAN``-th leaf begins one, and a replica's leaves fall where their ids do,
so lost or added records disturb their own node only. A node hashes its leaves in order, a
parent hashes its ``FAN`` children each with its first offset, from the parent's, and its
length. Roots are compared; where they differ only the children of mismatching nodes are,
and leaves are read only below nodes that still differ.

Without ``order`` a file holds its records by id, then hash. With it, the column gives the
records' places in each replica's file: records that stand in another order, within a node
or as whole nodes, are then found as moved.

Defined results: null url or html are empty; records may share an id, or have none, and are
told apart by content; of one id, lost contents pair with added ones as changed, in order of
their hashes; two empty tables agree; against an empty primary every record is extra. Other
columns are ignored. A node that holds very many leaves of a replica is hashed in rounds of
``FAN``, so no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import pick, running, saved

FAN = 64


def warc_record(record_id: Column, uri: Column, payload: Column) -> Column:
    """The bytes of a response record."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def by_id(*more: Column) -> list[Column]:
    return [F.asc_nulls_first("id"), F.asc("hash"), *more]


def leaves(records: DataFrame, placed: bool) -> DataFrame:
    """``id, hash, bytes, n`` of the distinct records of (id, uri, payload, at), and if placed ``first, last``: offsets of the
    first and last copy."""
    record = warc_record(F.col("id"), F.col("uri"), F.col("payload"))
    hashed = records.select("id", F.sha2(record, 256).alias("hash"), F.octet_length(record).cast("long").alias("bytes"),
                            *(["at"] if placed else []))
    if not placed:
        return hashed.groupBy("id", "hash", "bytes").agg(F.count(F.lit(1)).alias("n"))
    laid = running(hashed, [F.asc_nulls_first("at"), *by_id()], {"offset": F.col("bytes")})
    return laid.groupBy("id", "hash", "bytes").agg(
        F.count(F.lit(1)).alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))


def located(leaves: DataFrame, splits: DataFrame | None, placed: bool, fan: int) -> DataFrame:
    """Leaves with their ``node``, their ``position`` by id, and offsets. Without splits the leaves make the nodes."""
    marked = leaves.withColumn("split", F.lit(0).cast("long"))
    if splits is not None:
        marked = marked.unionByName(splits.withColumn("split", F.lit(1).cast("long")), allowMissingColumns=True)
    sums = {"opened": F.col("split")}
    if not placed:
        sums["first"] = F.coalesce(F.col("n") * F.col("bytes"), F.lit(0))
    found = running(marked, by_id(F.desc("split")), sums).where("split = 0")
    if splits is not None:
        node = F.greatest(F.col("opened") - 1, F.lit(0)).cast("long")
        found = found.withColumn("position", F.col("position") - F.col("opened"))
    else:
        node = F.floor(F.col("position") / fan).cast("long")
    if not placed:
        found = found.withColumn("last", F.col("first") + (F.col("n") - 1) * F.col("bytes"))
    return saved(found.select(node.alias("node"), "position", "id", "hash", "bytes", "n", "first", "last"), "leaves")


def _digest(group: list[str], parts: DataFrame, *totals: Column) -> DataFrame:
    """One hash over the ``part`` strings of each group, at most a fan of them, in order of ``place``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda p: p["part"])
    return parts.groupBy(*group).agg(F.sha2(F.concat_ws("\n", ordered), 256).alias("hash"), *totals)


def tree(leaves: DataFrame, levels: int, fan: int) -> list[DataFrame]:
    """Levels of (node, hash, first, length), from the nodes over leaves up to the root."""
    spans = saved(leaves.groupBy("node").agg(F.min("position").alias("from"), F.min("first").alias("begin"),
                                             F.sum(F.col("n") * F.col("bytes")).alias("length")), "node-spans")
    part = F.concat_ws(" ", F.col("first") - F.col("begin"), F.col("last") - F.col("first"), "n", "bytes", "hash")
    runs = leaves.join(spans, "node").select("node", (F.col("position") - F.col("from")).alias("place"), part.alias("part"))
    while True:
        parts = runs.withColumn("run", F.floor(F.col("place") / fan).cast("long"))
        runs = saved(_digest(["node", "run"], parts).select("node", F.col("run").alias("place"), F.col("hash").alias("part")), "merkle")
        if runs.where("place > 0").isEmpty():
            break
    nodes = runs.join(spans, "node").select("node", F.col("part").alias("hash"), F.col("begin").alias("first"), "length")
    out = [saved(nodes, "merkle")]
    for _ in range(levels):
        children = out[-1].withColumn("parent", F.floor(F.col("node") / fan).cast("long"))
        kids = F.array_sort(F.collect_list(F.struct("node", "first", "length", "hash")))  # at most ``fan`` of them
        parents = children.groupBy("parent").agg(kids.alias("kids"), F.min("first").alias("first"), F.sum("length").alias("length"))
        lines = F.transform("kids", lambda k: F.concat_ws(" ", k["node"], k["first"] - F.col("first"), k["length"], k["hash"]))
        out.append(saved(parents.select(F.col("parent").alias("node"), F.sha2(F.concat_ws("\n", lines), 256).alias("hash"),
                                        "first", "length"), "merkle"))
    return out


def _moved(rows: DataFrame, group: str) -> DataFrame:
    """The rows whose place among those of their group, at most a fan, differs between ``first`` and ``there``."""
    ours = F.row_number().over(Window.partitionBy(group).orderBy("first"))
    theirs = F.row_number().over(Window.partitionBy(group).orderBy("there"))
    return rows.withColumns({"_a": ours, "_b": theirs}).where("_a != _b").drop("_a", "_b")


def audit(primary: DataFrame, replica: DataFrame, *, record_id: str = "page_id", uri: str = "url", payload: str = "html",
          order: str | None = None, fan: int = FAN) -> DataFrame:
    """``record_id, kind, offset, length, replica_offset, copies`` of what differs.

    ``kind`` is missing, extra, changed or moved. ``offset`` and ``length`` place the record, or for moved nodes the range
    of records (record_id is null then), in the primary's file, ``replica_offset`` in the replica's; each is null where
    there is none. ``copies`` are the records that a row stands for, at these places first of all.
    """
    names = {"id": record_id, "uri": uri, "payload": payload, **({"at": order} if order else {})}
    placed = order is not None
    ours = located(leaves(pick(primary, **names), placed), None, placed, fan)
    splits = ours.where(F.col("position") % fan == 0).select("id", "hash")
    theirs = located(leaves(pick(replica, **names), placed), splits, placed, fan)
    nodes, levels = (ours.agg(F.max("node")).first()[0] or 0) + 1, 0
    while nodes > 1:
        nodes, levels = -(-nodes // fan), levels + 1
    bad, moved = None, None
    for mine, copy in zip(reversed(tree(ours, levels, fan)), reversed(tree(theirs, levels, fan))):
        sides = []
        for side in (mine, copy):
            side = side.withColumn("parent", F.floor(F.col("node") / fan).cast("long"))
            sides.append(side if bad is None else side.join(bad, "parent", "left_semi"))
        other = sides[1].select("node", F.col("parent").alias("parent2"), F.col("hash").alias("copy"), F.col("first").alias("there"))
        both = saved(sides[0].join(other, "node", "full").withColumn("parent", F.coalesce("parent", "parent2")), "compared")
        if placed:
            shifted = _moved(both.where("hash = copy"), "parent").select(
                F.lit(None).cast(primary.schema[record_id].dataType).alias("record_id"), F.lit("moved").alias("kind"),
                F.col("first").alias("offset"), "length", F.col("there").alias("replica_offset"), F.lit(1).cast("long").alias("copies"))
            moved = shifted if moved is None else moved.unionByName(shifted)
        bad = saved(both.where(~F.col("hash").eqNullSafe(F.col("copy"))).select(F.col("node").alias("parent")), "mismatches")
    below = [side.join(bad.withColumnRenamed("parent", "node"), "node", "left_semi") for side in (ours, theirs)]
    copy = below[1].select("hash", F.col("id").alias("id2"), F.col("bytes").alias("bytes2"), F.col("n").alias("n2"),
                           F.col("first").alias("there"))
    both = saved(below[0].join(copy.withColumnRenamed("hash", "hash2"), (F.col("hash") == F.col("hash2"))
                               & F.col("id").eqNullSafe(F.col("id2")), "full"), "leaves-compared")
    more = F.coalesce("n", F.lit(0)) - F.coalesce("n2", F.lit(0))
    lost = both.where(more > 0).select("id", "hash", "bytes", F.col("first").alias("offset"), more.alias("copies"))
    added = both.where(more < 0).select(F.col("id2").alias("id"), F.col("hash2").alias("hash"), F.col("bytes2").alias("bytes"),
                                        F.col("there"), (-more).alias("copies"))
    # Of one id, contents that went and contents that came, copy by copy, are changed records.
    turn = Window.partitionBy("id").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)

    def spans(side: DataFrame) -> DataFrame:
        begin = F.coalesce(F.sum("copies").over(turn), F.lit(0))
        return side.withColumn("from", begin).withColumn("to", F.col("from") + F.col("copies"))

    gone, come = spans(lost), spans(added).select(
        F.col("id").alias("id2"), F.col("hash").alias("hash2"), "there", F.col("from").alias("from2"), F.col("to").alias("to2"))
    overlap = F.least("to", "to2") - F.greatest("from", "from2")
    met = saved(gone.join(come, F.col("id").eqNullSafe(F.col("id2")) & (F.col("from") < F.col("to2")) & (F.col("from2") < F.col("to")))
                .withColumn("both", overlap), "changed")

    def row(kind: str, copies: Column, offset: Column, length: Column, there: Column, name: str = "id") -> list[Column]:
        return [F.col(name).alias("record_id"), F.lit(kind).alias("kind"), offset.cast("long").alias("offset"),
                length.cast("long").alias("length"), there.cast("long").alias("replica_offset"), copies.cast("long").alias("copies")]

    none = F.lit(None)
    changed = met.select(*row("changed", F.col("both"), F.col("offset"), F.col("bytes"), F.col("there")))
    paired = met.groupBy("id", "hash").agg(F.sum("both").alias("met"))
    paired2 = met.groupBy("id2", "hash2").agg(F.sum("both").alias("met"))

    def unpaired(side: DataFrame, done: DataFrame, name: str, hash_name: str) -> DataFrame:
        done = done.select(F.col(name).alias("_id"), F.col(hash_name).alias("_hash"), "met")
        left = F.col("copies") - F.coalesce("met", F.lit(0))
        return side.join(done, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left").withColumn(
            "left", left).where("left > 0")

    missing = unpaired(lost, paired, "id", "hash").select(*row("missing", F.col("left"), F.col("offset"), F.col("bytes"), none))
    extra = unpaired(added, paired2, "id2", "hash2").select(*row("extra", F.col("left"), none, none, F.col("there")))
    out = changed.unionByName(missing).unionByName(extra)
    if placed:
        same = _moved(both.where("n is not null and n2 is not null"), "node")
        out = out.unionByName(same.select(*row("moved", F.least("n", "n2"), F.col("first"), F.col("bytes"), F.col("there")))).unionByName(moved)
    return out

"""Folders that duplicate one another, or are contained in another.

Files are entries of their own folder alone. Signatures are rolled up from the deepest level: a folder's combines a hash
of the name and group of each of its files and of the name and signature of each folder in it, so each level's job has
rows for its folders only, and none has a row for each file and each folder above it. A folder is fully duplicated if all
files below it have a group. Folders of one signature have the same files at the same places: exact duplicates.

Containment starts from each folder's rarest file, found on the way up: a folder that holds another has a file of that
group at the same place, so it is a file of that name and group whose path ends alike that gives a candidate. Where even
that file is met often, folders are narrowed down by their rarest files one after the other: folders that ask for the same
files share a node of a tree, and what holds a node's files is looked up in its children's. Candidates
with fewer files go at once; the others are compared level by level, and where signatures agree not looked into further.
Where no folder has folders in it, a match is one of own files alone, and nothing is rolled up: files of one name and group
meet once, each with its folder's size and a 64-bit filter of what is in it, so hardly a pair but matches is left to count.
Matches are claimed from the top: folders at or below a claimed one are passed over, in the order of depth, then path. A
round claims at once all matches that no earlier one can touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.tables import dropped, saved

SEEDS = 1, 2
#: Candidates of a folder that are few enough to compare, and files that narrow down more than those, at most.
FEW, RARE = 16, 32
#: Rows of a saved table that a join hands to all tasks, at most.
HANDED = 100_000


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by merge. Saved tables are packed many times smaller than their rows in memory, so Spark would take large ones for small and gather them in the driver."""
    return left.join(right.hint("merge"), on, how)


def _handed(table: DataFrame) -> DataFrame:
    """A saved table that a join hands to all tasks if its rows, counted, are few, and deals by its key otherwise."""
    return table.hint("broadcast" if table.count() <= HANDED else "merge")


def entries(files: DataFrame, members: DataFrame, root: str) -> DataFrame:
    """dir, name, gid (null without a group), size: a row for each file below the root."""
    own = files.select("path", "size").where(paths.under(F.col("path"), root) & (F.col("path") != root))
    return placed(own.join(members.select("path", F.col("group_id").alias("gid")), "path", "left"))


def placed(files: DataFrame) -> DataFrame:
    """entries() of files below the root that have their gid beside them: path, size, gid."""
    return files.select(paths.parent(F.col("path")).alias("dir"), paths.name(F.col("path")).alias("name"), "gid", "size")


def _lanes(*columns) -> list:  # noqa: ANN002
    return [F.xxhash64(F.lit(seed), *columns).alias(lane) for seed, lane in zip(SEEDS, ("x", "y"))]


def rolled(own: DataFrame, root: str, rare: bool = True) -> DataFrame:
    """dir, sig, whole, file_count, bytes, inner (entries of its own), rare, saved: of all folders from the root down.

    own: entries(). whole: whether all files below have a group; rare: the file below whose name and group are met least
    often (often, dir, name, gid). Only containment needs it; without it, entries aren't joined with their numbers.
    """
    if rare:
        often = own.where("gid IS NOT NULL").groupBy("name", "gid").agg(F.count("*").alias("often"))
        rows = own.join(often, ["name", "gid"], "left")
    else:
        rows = own
    sums = [
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.bool_and("whole").alias("whole"), F.sum("file_count").alias("file_count"),
        F.sum("bytes").alias("bytes"), F.sum("inner").alias("inner"), *([F.min("rare").alias("rare")] if rare else []),
    ]
    kept = ["rare"] if rare else []
    least = [F.when(F.col("gid").isNotNull(), F.struct("often", "dir", "name", "gid")).alias("rare")] if rare else []
    one = F.lit(1).cast("long")
    direct = rows.select("dir", *_lanes(F.lit("file"), "name", "gid"), F.col("gid").isNotNull().alias("whole"), one.alias("file_count"), F.col("size").alias("bytes"), one.alias("inner"), *least)
    level = paths.depth(F.col("dir")).alias("depth")
    direct = saved(direct.groupBy("dir").agg(*sums).withColumn("depth", level), "own-files")
    ends = direct.agg(F.max("depth")).first()[0]
    top = direct.sparkSession.range(1).select(paths.depth(F.lit(root))).first()[0]
    done: list[DataFrame] = []
    for depth in range(ends or 0, top - 1, -1):
        here = direct.where(F.col("depth") == depth).drop("depth")
        if done:
            below = done[-1].select(paths.parent(F.col("dir")).alias("dir"), *_lanes(F.lit("folder"), paths.name(F.col("dir")), "x", "y"), "whole", "file_count", "bytes", one.alias("inner"), *kept)
            here = saved(here.unionByName(below).groupBy("dir").agg(*sums), "level")
        done.append(here)  # the deepest level is as its files are
    if not done:
        done = [direct.drop("depth")]
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    out = saved(every.select("dir", F.concat(F.hex("x"), F.lit("-"), F.hex("y")).alias("sig"), "whole", "file_count", "bytes", "inner", *kept), "folders")
    dropped(*done, direct)
    return out


def _content(own: DataFrame, folders: DataFrame) -> DataFrame:
    """dir, name, key: what is in each folder itself; the key tells files' groups and folders' signatures."""
    inner = folders.select(paths.parent(F.col("dir")).alias("dir"), paths.name(F.col("dir")).alias("name"), F.concat(F.lit("d"), "sig").alias("key"))
    return own.where("gid IS NOT NULL").select("dir", "name", F.concat(F.lit("f"), F.col("gid").cast("string")).alias("key")).unionByName(inner)


def _shared(folders: DataFrame) -> DataFrame:
    """sig, file_count, first folder of signatures that several folders have."""
    return folders.where("whole").groupBy("sig", "file_count").agg(F.count("*").alias("dirs"), F.min(paths.sort_key(F.col("dir"))).alias("k")).where("dirs > 1").select("sig", "file_count", F.col("k.path").alias("first"))


def exact(folders: DataFrame, own: DataFrame) -> DataFrame:
    """sig, dir, file_count, bytes of fully duplicated folders whose content is that of the first with their signature.

    What is in a folder itself is compared, name by name; folders in it are by their signatures.
    """
    near = folders.where("whole").join(_handed(saved(_shared(folders), "shared")), ["sig", "file_count"])
    # contents of both sides move to their folders once
    inside = saved(_met(near.select("dir", "first"), _content(own, folders), "dir"), "near-contents")
    met = _met(inside.where("dir <> first"), inside.where("dir = first").drop("dir"), ["first", "name", "key"])
    others = near.where("dir <> first").select("sig", "dir", "first", "file_count", "bytes", "inner")
    same = _met(others, met.groupBy("dir").agg(F.count("*").alias("n")), "dir").where("n = inner")
    heads = near.where("dir = first").join(same.select("first").distinct(), "first", "left_semi")
    columns = ["sig", "dir", "file_count", "bytes"]
    return same.select(*columns).unionByName(heads.select(*columns))


def _child(folder: str, name: str) -> Column:
    return F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), F.col(name))


def _holding(asked: DataFrame, grouped: DataFrame) -> DataFrame:
    """asked (name, gid, place) with superset: the folders that have this file at its place."""
    path = _child("dir", "name")
    met = asked.join(grouped, ["name", "gid"]).where(F.endswith(path, F.col("place")))
    base = F.substring(path, F.lit(1), F.length(path) - F.length("place"))
    return met.withColumn("superset", F.when(base == "", F.lit("/")).otherwise(base)).drop("dir")


def _narrowed(hard: DataFrame, folders: DataFrame, grouped: DataFrame, size: DataFrame) -> DataFrame:
    """subset, superset, file_count, bytes of folders (subset, file_count, bytes) whose files are all met often.

    A node stands for the first files of folders, in one order; a folder leaves the tree when few hold its node, or when its
    files (or RARE of them) are through.
    """
    often = grouped.groupBy("name", "gid").agg(F.count("*").alias("often"))
    below = folders.select("dir", F.explode(F.concat(paths.ancestors(F.col("dir")), F.array("dir"))).alias("subset"))
    below = _met(below, hard.select("subset"), "subset")
    inside = F.when(F.col("dir") == F.col("subset"), F.lit("")).otherwise(F.concat(F.lit("/"), paths.relative(F.col("dir"), F.col("subset"))))
    files = _met(below, grouped, "dir").join(often, ["name", "gid"]).select("subset", "often", "name", "gid", F.concat(inside, F.lit("/"), "name").alias("place"))
    rank = F.row_number().over(Window.partitionBy("subset").orderBy("often", "name", "gid", "place"))
    rarest = files.withColumn("rank", rank).where(F.col("rank") <= RARE).groupBy("subset").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "gid", "place"))).alias("files"))
    turn = lambda k: [F.col("files")[k][c].alias(c) for c in ("name", "gid", "place")]
    live = _met(hard, rarest, "subset")
    live = saved(live.withColumn("node", F.xxhash64(*turn(0))), "narrowed")
    first = saved(live.select("node", *turn(0), "file_count").groupBy("node", "name", "gid", "place").agg(F.min("file_count").alias("least")), "steps")
    nodes = saved(_met(_holding(_handed(first), grouped), size, "superset").where("most >= least").select("node", "superset", "most"), "nodes")
    dropped(first)
    out: list[DataFrame] = []
    for k in range(1, RARE + 1):
        met = _met(live, nodes.groupBy("node").agg(F.count("*").alias("n")), "node")
        through = (F.col("n") <= FEW) | (F.size("files") <= k)
        done = met.where(through & (F.col("n") > 1)).select("subset", "file_count", "bytes", "node")
        pairs = _met(done, nodes, "node").where("subset <> superset AND most >= file_count")
        out.append(saved(pairs.select("subset", "superset", "file_count", "bytes"), "few"))
        rest = saved(met.where(~through).drop("n"), "narrowed")
        dropped(live)
        if rest.isEmpty():
            dropped(nodes, rest)
            break
        step = rest.select(F.col("node").alias("up"), F.xxhash64("node", *turn(k)).alias("node"), *turn(k), "file_count")
        step = saved(step.groupBy("up", "node", "name", "gid", "place").agg(F.min("file_count").alias("least")), "steps")
        # what a folder has at a place is looked up once, whatever is asked for there
        spots = saved(step.groupBy("up", "name", "place").agg(F.min("least").alias("least")), "spots")
        asked = nodes.withColumnRenamed("node", "up").join(_handed(spots), "up").where("most >= least")
        where = F.concat(F.regexp_replace("superset", "/$", ""), F.regexp_replace("place", "/[^/]*$", ""))
        there = asked.select("up", "superset", "most", "place", F.when(where == "", F.lit("/")).otherwise(where).alias("dir"), "name")
        there = _met(there, grouped, ["dir", "name"]).join(_handed(step), ["up", "name", "place", "gid"])
        now = saved(there.where("most >= least").select("node", "superset", "most"), "nodes")
        live = saved(rest.withColumn("node", F.xxhash64("node", *turn(k))), "narrowed")
        dropped(nodes, rest, step, spots)
        nodes = now
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every


def candidates(folders: DataFrame, own: DataFrame) -> DataFrame:
    """subset, superset, file_count, bytes: pairs that agree in the subset's rarest files, the superset not the smaller.

    A folder of an exact cluster isn't looked at as a subset.
    """
    alone = folders.where("whole").join(_shared(folders), ["sig", "file_count"], "left_anti")
    place = F.concat(F.lit("/"), F.when(F.col("rare.dir") == F.col("dir"), F.lit("")).otherwise(F.concat(paths.relative(F.col("rare.dir"), F.col("dir")), F.lit("/"))), F.col("rare.name"))
    asked = saved(alone.select(F.col("dir").alias("subset"), "file_count", "bytes", "rare.often", F.col("rare.name").alias("name"), F.col("rare.gid").alias("gid"), place.alias("place")), "asked")
    grouped, size = own.where("gid IS NOT NULL").select("dir", "name", "gid"), folders.select(F.col("dir").alias("superset"), F.col("file_count").alias("most"))
    # a file that is met once is the folder's own
    found = _met(_holding(asked.where(F.col("often").between(2, FEW)).hint("merge"), grouped), size, "superset").where("subset <> superset AND most >= file_count")
    found = found.select("subset", "superset", "file_count", "bytes")
    hard = asked.where(F.col("often") > FEW).select("subset", "file_count", "bytes")
    return found if hard.isEmpty() else found.unionByName(_narrowed(hard, folders, grouped, size))


def contained(folders: DataFrame, own: DataFrame) -> DataFrame:
    """subset, superset, file_count, bytes: fully duplicated folders all of whose files another has at the same places."""
    left = saved(candidates(folders, own), "candidates")
    pairs = left.select("subset", "superset", F.col("subset").alias("s"), F.col("superset").alias("t"))
    grouped = own.where("gid IS NOT NULL").select("dir", "name", "gid")
    inner = folders.select(paths.parent(F.col("dir")).alias("s"), paths.name(F.col("dir")).alias("name"), "sig")
    there = folders.select(F.col("dir").alias("t_below"), F.col("sig").alias("t_sig"))
    child = lambda c: F.concat(F.regexp_replace(c, "/$", ""), F.lit("/"), F.col("name"))
    spent = []
    while True:
        missing = _met(_met(pairs, grouped.withColumnRenamed("dir", "s"), "s"), grouped.withColumnRenamed("dir", "t"), ["t", "name", "gid"], "left_anti")
        step = _met(pairs, inner, "s").select("subset", "superset", child("s").alias("s"), child("t").alias("t_below"), "sig")
        step = _met(step, there, "t_below", "left")
        step = saved(step.where("t_sig IS NULL OR t_sig <> sig"), "unlike")
        bad = missing.select("subset", "superset").unionByName(step.where("t_sig IS NULL").select("subset", "superset")).distinct()
        now = saved(left.join(bad, ["subset", "superset"], "left_anti"), "contained")
        dropped(left, *spent)
        left, spent = now, [step]
        pairs = _met(step.where("t_sig IS NOT NULL"), left.select("subset", "superset"), ["subset", "superset"], "left_semi").select("subset", "superset", "s", F.col("t_below").alias("t"))
        if pairs.isEmpty():
            return left


def marked(own: DataFrame) -> DataFrame:
    """entries() with n, bytes, bits of their folders: files, their bytes and a filter of names and groups, in which a bit stands for each file."""
    bit = F.expr("CASE WHEN gid IS NOT NULL THEN shiftleft(1L, CAST(xxhash64(name, gid) & 63 AS INT)) ELSE 0L END")
    here = Window.partitionBy("dir")
    return own.select("dir", "name", "gid", F.count("*").over(here).alias("n"), F.sum("size").over(here).alias("bytes"), F.bit_or(bit).over(here).alias("bits"), "size")


def flat_matches(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """exact() and contained() of folders that have no folders in them, by marked() entries.

    Files of a name and group that at most FEW folders have show all pairs of these that sizes and filters let match; a pair
    that as many files show as the subset has is one. Files that are met more often are kept apart: they are looked up for
    pairs that lack no others, and folders that have no others go by signatures, and are narrowed down, as in contained().
    """
    key = Window.partitionBy("gid", "name")
    # no more of a key than tells that it is met often
    met = own.where("gid IS NOT NULL").withColumn("turn", F.row_number().over(key.orderBy("dir"))).where(F.col("turn") <= FEW + 1)
    met = met.withColumn("held", F.collect_list(F.struct("dir", "n", "bits")).over(key))
    partners = F.expr("transform(filter(held, t -> t.dir <> dir AND t.n >= n AND (bits & ~t.bits) = 0), t -> struct(t.dir AS dir, t.n AS n))")
    mark = F.when(F.col("turn") == 1, F.expr("array(struct(CAST(NULL AS STRING) AS dir, 0L AS n))"))
    often = F.size("held") > FEW
    at = [F.when(F.col("t.dir").isNull(), F.col(c)).alias(c) for c in ("name", "gid")]
    shown = met.select("dir", "n", "bytes", "name", "gid", F.explode(F.when(often, mark).otherwise(partners)).alias("t"))
    shown = saved(shown.select(F.col("dir").alias("subset"), F.col("t.dir").alias("superset"), F.col("n").alias("file_count"), "bytes", F.col("t.n").alias("most"), *at), "shown")
    pairs = shown.where("superset IS NOT NULL").groupBy("subset", "superset", "file_count", "bytes", "most").agg(F.count("*").alias("c"))
    columns = ["subset", "superset", "file_count", "bytes"]
    clusters = narrow = None
    spent = [shown]
    common = shown.where("superset IS NULL").select("name", "gid")
    if common.isEmpty():
        pairs = pairs.where("c = file_count")
    else:
        hot = saved(own.join(_handed(common), ["name", "gid"], "left_semi"), "often-met")
        mine = hot.groupBy("dir", "n", "bytes").agg(F.count("*").alias("h"), *(F.bit_xor(x).alias(lane) for x, lane in zip(_lanes(F.lit("file"), "name", "gid"), "xy")))
        mine = saved(mine, "often-met-folders")
        pairs = saved(_met(pairs, mine.select(F.col("dir").alias("subset"), "h"), "subset", "left").where("c + coalesce(h, 0) = file_count"), "shown-whole")
        whole = mine.where("h = n").select("dir", F.concat(F.hex("x"), F.lit("-"), F.hex("y")).alias("sig"), F.lit(True).alias("whole"), F.col("n").alias("file_count"), "bytes", F.col("n").alias("inner"))
        inside = hot.select("dir", "name", "gid")
        clusters = saved(exact(whole, inside), "clusters")
        alone = whole.join(_shared(whole), ["sig", "file_count"], "left_anti").select(F.col("dir").alias("subset"), "file_count", "bytes")
        open_ = pairs.where("h IS NOT NULL").select("subset", "superset")
        if not alone.isEmpty():
            narrow = saved(_narrowed(alone, whole, inside, mine.select(F.col("dir").alias("superset"), F.col("n").alias("most"))), "candidates")
            open_ = open_.unionByName(narrow.select("subset", "superset"))
        missing = _met(_met(open_, inside.withColumnRenamed("dir", "subset"), "subset"), inside.withColumnRenamed("dir", "superset"), ["superset", "name", "gid"], "left_anti")
        missing = saved(missing.select("subset", "superset").distinct(), "missing")
        pairs = _met(pairs, missing, ["subset", "superset"], "left_anti")
        narrow = _met(narrow, missing, ["subset", "superset"], "left_anti").select(*columns) if narrow is not None else None
        spent += [hot, mine]
    # the first of the folders that have the same files, or null
    twin = F.min(F.when(F.col("most") == F.col("file_count"), F.col("superset"))).over(Window.partitionBy("subset"))
    pairs = saved(pairs.select(*columns, twin.alias("twin")), "flat-matches")
    dropped(*spent)
    same = pairs.where("twin IS NOT NULL").select(F.least("subset", "twin").alias("sig"), F.col("subset").alias("dir"), "file_count", "bytes").distinct()
    within = pairs.where("twin IS NULL").select(*columns)
    return same if clusters is None else same.unionByName(clusters), within if narrow is None else within.unionByName(narrow)


def claimed(clusters: DataFrame, subsets: DataFrame) -> DataFrame:
    """match, dir of the folders that matches claim, from the top.

    clusters: sig, dir. subsets: subset. A cluster is looked at when the first of its folders that is free comes up, and
    claims all that are free if they are several; a subset claims itself. A folder is free unless one at or above it is
    claimed. In each round, of two matches with a folder of one above a folder of the other, that which comes up later
    waits; all others claim, and what they cover is struck off. The first match of all never waits.
    """
    all_ = clusters.select(F.concat(F.lit("="), "sig").alias("match"), "dir").unionByName(subsets.select(F.concat(F.lit("<"), "subset").alias("match"), F.col("subset").alias("dir")).distinct())
    left = saved(all_.withColumn("at", F.struct(paths.depth(F.col("dir")).alias("depth"), paths.components(F.col("dir")).alias("parts"))), "claims")
    taken = []
    while not left.isEmpty():
        now = _met(left, left.groupBy("match").agg(F.min("at").alias("first")), "match")
        above = now.select("match", "first", F.explode(paths.ancestors(F.col("dir"))).alias("dir"))
        rival = now.select("dir", F.col("match").alias("rival"), F.col("first").alias("rival_first"))
        later = F.when(F.col("rival_first") < F.col("first"), F.col("match")).otherwise(F.col("rival"))
        waits = _met(above, rival, "dir").where(F.col("rival") != F.col("match")).select(later.alias("match")).distinct()
        ready = saved(now.join(waits, "match", "left_anti").select("match", "dir"), "ready")
        enough = ready.groupBy("match").agg(F.count("*").alias("n")).where(F.startswith("match", F.lit("<")) | (F.col("n") > 1)).select("match")
        mine = saved(ready.join(enough, "match", "left_semi"), "claimed")
        taken.append(mine)
        rest = left.join(ready.select("match").distinct(), "match", "left_anti")
        up = rest.select("match", F.col("dir").alias("below"), F.explode(paths.ancestors(F.col("dir"))).alias("dir"))
        covered = _met(up, mine.select("dir"), "dir", "left_semi").select("match", F.col("below").alias("dir")).distinct()
        rest = saved(rest.join(covered, ["match", "dir"], "left_anti"), "claims")
        dropped(left, ready)
        left = rest
    out = all_.limit(0)
    for mine in taken:
        out = out.unionByName(mine)
    return out


def folder_matches(files: DataFrame, members: DataFrame, root: str) -> DataFrame:
    """kind, folders (in order), subset, superset, file_count, bytes."""
    own = saved(entries(files, members, root), "entries")
    folders = rolled(own, root)
    same, within = saved(exact(folders, own), "clusters"), contained(folders, own)
    taken = claimed(same, within)
    none = F.lit(None).cast("string")
    key = paths.sort_key(F.col("dir"))
    whole = _met(same.withColumn("match", F.concat(F.lit("="), "sig")), taken, ["match", "dir"]).groupBy("sig", "file_count").agg(F.min("bytes").alias("bytes"), F.transform(F.array_sort(F.collect_list(key)), lambda x: x["path"]).alias("folders"))
    parts = _met(within, taken.where(F.startswith("match", F.lit("<"))).select(F.col("dir").alias("subset")), "subset")
    return whole.select(F.lit("exact").alias("kind"), "folders", none.alias("subset"), none.alias("superset"), "file_count", "bytes").unionByName(
        parts.select(F.lit("contained").alias("kind"), F.lit(None).cast("array<string>").alias("folders"), "subset", "superset", "file_count", "bytes")
    )

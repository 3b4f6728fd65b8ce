"""Problem 1: splits that keep related records together."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.names import squeeze
from framelake.llm.common import identity_number
from framelake.llm.components import components
from framelake.operators.live import latest
from framelake.operators.selection import hash_rank
from framelake.session import cut
from framelake.sources.tables import small_enough, table

#: Texts in photo_id that are no photo, beside numbers of zeros only (fixed values).
NO_PHOTO = ["", "none", "null", "nan", "na", "n/a", "unknown", "unk", "-", "--", "?", "???", "tbd", "misc", "missing", "no photo", "nophoto", "undefined", "photo", "ph", "x"]


def photo_key(photo: Column | str) -> Column:
    """Normal form of a photo id: trimmed, lower case; placeholders give null."""
    c = F.lower(F.trim(F.regexp_replace(F.col(photo) if isinstance(photo, str) else photo, r"^[\s ]+|[\s ]+$", "")))
    zeros = c.rlike(r"^(?:[a-z]+[-_ :])*[a-z]?0+$")
    return F.when(c.isNotNull() & ~c.isin(NO_PHOTO) & ~zeros, c)


def face_identities(face: DataFrame, identity: DataFrame) -> DataFrame:
    """face_id, identity (number of the wordnetid), photo, folder; faces without identity are left out.

    The identity is that named by wordnetid, else by category (an id or a person's name), else by
    the folder of the file. Repeats of a face_id count once.
    """
    path = F.regexp_extract(F.lower("filename"), r"([^/\\]+)[/\\][^/\\]*$", 1)
    cols = {
        "own": identity_number("wordnetid"),
        "named": identity_number("category"),
        "folder_id": F.when(path.rlike(r"^n[-_]?[0-9]+$"), identity_number(path)),
        "person": F.when(identity_number("category").isNull(), squeeze("category")),
        "photo": photo_key("photo_id"),
        "folder": F.regexp_extract(F.lower("filename"), r"([^/\\]+)[/\\][^/\\]+[/\\][^/\\]*$", 1),
    }
    rows = latest(face, "face_id", "ingested_at", cols)
    people = identity.where("person_name is not null").groupBy(squeeze("person_name").alias("person")).agg(F.min(identity_number("wordnetid")).alias("person_id"))
    rows = rows.join(F.broadcast(people) if small_enough(people) else people, "person", "left")
    rows = rows.withColumn("identity", F.coalesce("own", "named", "person_id", "folder_id"))
    return rows.where("identity is not null").select("face_id", "identity", "photo", "folder")


def identity_groups(rows: DataFrame, identity: DataFrame) -> DataFrame:
    """identity, component: identities tied by same_as or by a common photo, through any steps.

    A photo ties its identities as a star around the smallest one: as many edges as identities.
    """
    in_photo = rows.where("photo is not null").select("photo", "identity").distinct()
    centre = in_photo.groupBy("photo").agg(F.min("identity").alias("least"))
    by_photo = in_photo.join(centre, "photo").where("identity <> least").select(F.col("identity").alias("u"), F.col("least").alias("v"))
    stated = identity.select(identity_number("wordnetid").alias("u"), identity_number("same_as").alias("v"))
    return components(by_photo.unionByName(stated), "u", "v").select(F.col("node").alias("identity"), "component")


def grouped_faces(face: DataFrame, identity: DataFrame) -> DataFrame:
    """face_id, folder, identity, component, group_id (smallest identity with a face), n_identities."""
    rows = cut(face_identities(face, identity))
    ties = identity_groups(rows, identity)
    sizes = rows.groupBy("identity").agg(F.count(F.lit(1)).alias("n"))
    tied = sizes.join(ties, "identity", "left").select("identity", F.coalesce("component", "identity").alias("component"))
    groups = tied.groupBy("component").agg(F.min("identity").alias("group_id"), F.count(F.lit(1)).alias("n_identities"))
    of = tied.join(groups, "component")
    return rows.join(F.broadcast(of) if small_enough(of) else of, "identity")


# --- min-cost flow allocation -------------------------------------------------------------------


class Flow:
    """Min-cost flow by successive shortest paths; small graphs only (bundle classes x splits)."""

    def __init__(self, n: int):
        self.g: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, cap: int, cost: float) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.g[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def solve(self, s: int, t: int) -> None:
        while True:
            dist, via, queued, queue = {s: 0.0}, {}, {s}, deque([s])
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.g[x]:
                    y, d = self.to[e], dist[x] + self.cost[e]
                    if self.cap[e] > 0 and d < dist.get(y, float("inf")) - 1e-9:
                        dist[y], via[y] = d, e
                        if y not in queued:
                            queued.add(y)
                            queue.append(y)
            if t not in dist:
                return
            path, y = [], t
            while y != s:
                path.append(via[y])
                y = self.to[via[y] ^ 1]
            most = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= most
                self.cap[e ^ 1] += most


@dataclass
class Bundle:
    """`n` components of `size` records each with the same label profile."""

    size: int
    label: str
    n: int


def allocate(bundles: list[Bundle], shares: dict[str, float]) -> dict[tuple[int, str], list[tuple[str, int]]]:
    """For each (size, label): how many components go to each split.

    Flow: bundles send their records to splits; a (label, split) cell takes its quota at no cost and
    more at cost 1, a split takes its quota at no cost and more at cost 4 a record. A component larger
    than a split's whole quota has no arc to it (but always one to the largest split). Bundles with
    the same label and the same arcs differ in nothing the flow sees, so they are one node whose
    flow each takes its share of. The flow is rounded to whole components, largest sizes first: each split gets what its part of the flow holds, a left-over component goes to the
    split that lacks most; the smallest sizes, coming last, even out what rounding moved.
    """
    splits = sorted(shares, key=lambda s: (-shares[s], s))
    weight = sum(shares.values()) or 1
    total = sum(b.size * b.n for b in bundles)
    quota = {s: total * shares[s] / weight for s in splits}
    labels = sorted({b.label for b in bundles})
    allowed = lambda b: tuple(s for s in splits if s == splits[0] or b.size <= quota[s])
    classes = sorted({(b.label, allowed(b)) for b in bundles})
    supply = {c: sum(b.size * b.n for b in bundles if (b.label, allowed(b)) == c) for c in classes}
    of_label = {x: sum(b.size * b.n for b in bundles if b.label == x) for x in labels}
    n = 2 + len(classes) + len(labels) * len(splits) + len(splits)
    flow, source, sink = Flow(n), 0, 1
    cell = {(x, s): 2 + len(classes) + i * len(splits) + j for i, x in enumerate(labels) for j, s in enumerate(splits)}
    node = {s: n - len(splits) + j for j, s in enumerate(splits)}
    arcs = {}
    for i, c in enumerate(classes):
        flow.arc(source, 2 + i, supply[c], 0)
        for s in c[1]:
            arcs[c, s] = flow.arc(2 + i, cell[c[0], s], supply[c], 0)
    for (x, s), v in cell.items():
        flow.arc(v, node[s], int(of_label[x] * shares[s] / weight), 0)
        flow.arc(v, node[s], of_label[x], 1)
    for s, v in node.items():
        flow.arc(v, sink, int(quota[s]), 0)
        flow.arc(v, sink, total, 4)
    flow.solve(source, sink)
    left = {(c, s): float(flow.cap[e ^ 1]) for (c, s), e in arcs.items()}
    out = {}
    for b in sorted(bundles, key=lambda b: (-b.size, b.label)):
        c = (b.label, allowed(b))
        have = sum(max(0.0, left[c, s]) for s in c[1])
        part, rest = {}, b.n
        for s in c[1]:
            want = max(0.0, left[c, s]) * b.size * b.n / have if have else 0
            part[s] = min(rest, int(want // b.size))
            rest -= part[s]
            left[c, s] -= part[s] * b.size
        while rest:
            lack = {s: left[c, s] for s in c[1]}
            s = max(c[1], key=lambda s: (lack[s], shares[s]))
            k = min(rest, max(1, int((lack[s] - sorted(lack.values())[-2]) // b.size))) if len(lack) > 1 else rest
            part[s] += k
            left[c, s] -= k * b.size
            rest -= k
        out[b.size, b.label] = [(s, part[s]) for s in c[1] if part[s]]
    return out


#: Labels whose quotas are solved apart, those with most records; the others share one quota.
LABELS = 64


def split_groups(groups: DataFrame, group: str, size: str, label: str, shares: dict[str, float], most_labels: int = LABELS) -> DataFrame:
    """`group` (bigint, unique) and `split`; whole groups, near the shares in records overall and per label.

    What comes to the driver is the histogram of (size, label): for R records at most sqrt(2 R) sizes
    for each of the most_labels + 1 labels. Within a bundle, groups are taken in the order of a hash of their key, so the result
    does not depend on partitioning. A null label counts as ''. No groups give an empty result.
    """
    g = groups.select(F.col(group).cast("long").alias("_g"), F.col(size).cast("long").alias("_n"), F.coalesce(F.col(label), F.lit("")).alias("_l"))
    top = g.groupBy("_l").agg(F.sum("_n").alias("_records")).orderBy(F.desc("_records"), "_l").limit(most_labels).collect()
    g = g.withColumn("_l", F.when(F.col("_l").isin([r["_l"] for r in top]), F.col("_l")).otherwise(""))
    bundles = [Bundle(r["_n"], r["_l"], r["k"]) for r in g.groupBy("_n", "_l").agg(F.count(F.lit(1)).alias("k")).collect()]
    plan = allocate(bundles, shares)
    bounds = []
    for (n, x), parts in plan.items():
        upto = 0
        for s, k in parts:
            bounds.append((n, x, upto, upto + k, s))
            upto += k
    spark = groups.sparkSession
    places = spark.createDataFrame(bounds, "_n long, _l string, _from long, _to long, split string")
    ranked = hash_rank(g, ["_n", "_l"], "_g")
    out = ranked.join(F.broadcast(places) if small_enough(places) else places, ["_n", "_l"]).where("rank > _from and rank <= _to")
    return out.select(F.col("_g").alias(group), "split")


# --- queries ------------------------------------------------------------------------------------


def wordnetid(number: Column | str) -> Column:
    return F.concat(F.lit("n"), F.lpad(F.col(number).cast("string") if isinstance(number, str) else number.cast("string"), 8, "0"))


def found(face: DataFrame, identity: DataFrame) -> DataFrame:
    """face_id, group_id of each face whose group has faces of two or more identities."""
    return grouped_faces(face, identity).where("n_identities >= 2").select("face_id", wordnetid("group_id").alias("group_id"))


def face_splits(face: DataFrame, identity: DataFrame, shares: dict[str, float]) -> DataFrame:
    """face_id, group_id, split, n_identities: all faces of one group in one split.

    The label profile of a group is the delivery folder most of its faces lie in.
    """
    rows = cut(grouped_faces(face, identity).select("face_id", "group_id", "folder", "n_identities"))
    per = rows.groupBy("group_id", "folder").agg(F.count(F.lit(1)).alias("n"))
    groups = per.groupBy("group_id").agg(F.sum("n").alias("n"), F.max_by("folder", F.struct("n", "folder")).alias("folder"))
    placed = cut(split_groups(groups, "group_id", "n", "folder", shares))
    out = rows.join(F.broadcast(placed) if small_enough(placed) else placed, "group_id")
    return out.select("face_id", wordnetid("group_id").alias("group_id"), "split", "n_identities")


def shares_of(split_target: DataFrame) -> dict[str, float]:
    """Proportions by split name; a name stated several times counts with the sum of its shares."""
    stated = split_target.where("split_name is not null and permille > 0").groupBy("split_name").agg(F.sum("permille").alias("permille"))
    return {r["split_name"]: float(r["permille"]) for r in stated.collect()}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the faces with their splits, those whose group ties several identities."""
    faces = face_splits(table(spark, d, "face"), table(spark, d, "face_identity"), shares_of(table(spark, d, "split_target")))
    return faces.where("n_identities >= 2").select("face_id", "group_id")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per split: whether its share of the faces is within a hundredth of its target, and whether no group lies in two splits."""
    faces = cut(p1_splits(spark, d))
    shares = shares_of(table(spark, d, "split_target"))
    torn = faces.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    have = {r["split"]: r["n"] for r in faces.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, weight = max(1, sum(have.values())), sum(shares.values())
    rows = [(s, abs(have.get(s, 0) / total - w / weight) <= 0.01, torn) for s, w in shares.items()]
    return spark.createDataFrame(rows, "split_name string, near boolean, whole_groups boolean")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return face_splits(table(spark, d, "face"), table(spark, d, "face_identity"), shares_of(table(spark, d, "split_target"))).drop("n_identities")

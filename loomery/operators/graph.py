"""Points and road graphs: grid joins, nearest neighbours, snapping, shortest paths, components.

Searches over a graph run as rounds of joins and minima over an edge table, each round's state
written as a table, so the graph may be larger than any machine and a lost executor costs one round.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km

_own: dict[str, str] = {}
KM_A_DEGREE = EARTH_KM * math.pi / 180


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or one of our own in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="loomery-", dir=os.environ.get("TMPDIR")))
    return f"{folder.rstrip('/')}/loomery-{name}/{uuid.uuid4().hex}"


_written: dict[str, list[str]] = {}


def release(spark: SparkSession) -> None:
    """Delete the tables that `kept` wrote in this session: once the results that read them are written themselves."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back; `release` deletes it."""
    path = shared_folder(df.sparkSession, "graph")
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def turn(degrees: Column) -> Column:
    """A difference of longitudes the shorter way: -180 to 180."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def _band(lat: Column, km: float) -> Column:
    return F.floor(lat / (km / KM_A_DEGREE)).cast("long")


def _width(band: Column, km: float) -> Column:
    """Degrees of longitude that hold `km` anywhere in a band of latitude or the bands beside it."""
    height = km / KM_A_DEGREE
    far = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * height, F.lit(90.0))
    share = F.lit(math.sin(min(km / (2 * EARTH_KM), math.pi / 2))) / F.greatest(F.cos(F.radians(far)), F.lit(1e-9))
    return F.least(F.degrees(2 * F.asin(F.least(share, F.lit(1.0)))) * 1.000001, F.lit(360.0))


def within(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs at most `km` apart, with their distance, at any latitude and over the date line.

    Points are put into bands of latitude `km` high and cells as wide as `km` is at that latitude; right
    rows are copied to the nine cells around them, so pairs come from an equality on cells. Nulls pair
    with nothing.
    """
    step = lambda n: F.array(*[F.lit(i) for i in n])
    cells = left.withColumn("__cy", _band(F.col(lat), km)).withColumn("__cx", F.floor(F.col(lon) / _width(F.col("__cy"), km)).cast("long"))
    near = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.explode(F.transform(step((-1, 0, 1)), lambda d: _band(F.col(lat), km) + d)).alias("__cy"))
    turned = near.withColumn("__w", _width(F.col("__cy"), km)).withColumn("__lon", F.explode(F.transform(step((-360, 0, 360)), lambda d: F.col(f"r_{lon}") + d)))
    turned = turned.where(F.col("__lon").between(-180 - F.col("__w"), 180 + F.col("__w")))
    turned = turned.withColumn("__cx", F.explode(F.sequence(F.floor(F.col("__lon") / F.col("__w")).cast("long") - 1, F.floor(F.col("__lon") / F.col("__w")).cast("long") + 1)))
    pairs = cells.join(turned.drop("__w", "__lon").distinct(), ["__cy", "__cx"]).drop("__cy", "__cx")
    return pairs.withColumn("km", haversine_km(F.col(lat), F.col(lon), F.col(f"r_{lat}"), F.col(f"r_{lon}"))).where(F.col("km") <= km)


def nearest_of(points: DataFrame, places: DataFrame, key: str, unique: str, k: int, first_km: float | None = None) -> DataFrame:
    """(key, rank, unique, metres): of every point the k nearest places in whole metres, ties to the smaller `unique`.

    points: key, lat, lon; places: unique, lat, lon. Rings grow: a round pairs the points that are left with the
    places within a radius, and a point is done when its k-th place is nearer than that; the others go on with
    twice the radius. The first radius is one that holds about 2 k places where they are spread evenly over
    the cells they are in. Only k rows a point are kept, in each task first. With fewer than k places a
    point gets them all; nulls are no points and no places.
    """
    places = kept(places.select(unique, "lat", "lon").where(F.col("lat").isNotNull() & F.col("lon").isNotNull()))
    left = kept(points.select(key, "lat", "lon").where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct())
    total = places.count()
    half = math.pi * EARTH_KM * 1.001
    if first_km is None:
        cells = places.select(F.floor("lat"), F.floor("lon")).distinct().count()
        share = 2 * k / max(total, 1) * cells * KM_A_DEGREE**2 / math.pi
        first_km = max(math.sqrt(share), 0.05)
    done, km = [], first_km
    while True:
        km = min(km, half)
        found = within(left, places, km).withColumn("metres", F.floor(F.col("km") * 1000 + 0.5).cast("long")).select(key, F.col(f"r_{unique}").alias(unique), "metres")
        turn_ = Window.partitionBy(key).orderBy("metres", unique)
        first = kept(found.withColumn("rank", F.row_number().over(turn_)).where(F.col("rank") <= k).select(key, "rank", unique, "metres"))
        if km >= half:
            done.append(first)
            break
        # one metre less than the ring, as a place just outside may round to the same metre
        sure = first.where((F.col("rank") == k) & (F.col("metres") < math.floor(km * 1000) - 1)).select(key)
        done.append(first.join(sure, key, "left_semi"))
        left = kept(left.join(sure, key, "left_anti"))
        if left.isEmpty():
            break
        km *= 2
    return reduce(DataFrame.unionByName, done)


def nearest(points: DataFrame, lat: Column, lon: Column, k: int, unique: str) -> DataFrame:
    """The k points nearest to one origin; each task keeps k."""
    return points.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), lat, lon)).orderBy("km", unique).limit(k)


def snap(points: DataFrame, segments: DataFrame, key: str, fast_kmh: int = 80, penalty_m: float = 150.0, reach_m: float = 2000.0) -> DataFrame:
    """Each point's best admissible segment within `reach_m`: the least distance to it, fast roads counting penalty_m more.

    segments: seg, lat1, lon1, lat2, lon2, speed. Local plane around the point. A segment is copied to
    the cells that it runs through, sampled every quarter of a cell, and a point looks into the nine
    cells around it; cells are as large as twice the reach, so none within it is missed. A segment runs the shorter
    way around the globe, over the date line if that is it. Points in one place have one answer, and of segments that run
    alike and are alike fast only the first can be one, so places meet lines, however many points and segments share them.
    Adds seg, share (0..1 along it) and metres.
    """
    ends = ["lat1", "lon1", "lat2", "lon2"]
    segments = segments.groupBy(*ends, F.coalesce(F.col("speed") >= fast_kmh, F.lit(False)).alias("__fast")).agg(F.min("seg").alias("seg"))
    places = points.select("lat", "lon").distinct()
    high = 2 * reach_m / 1000 / KM_A_DEGREE
    # as wide in degrees as the reach is at the latitude farthest from the equator that has points
    wide = lambda lat: F.lit(high) / F.greatest(F.cos(F.radians(F.least(F.abs(F.floor(lat)) + 2, F.lit(89)))), F.lit(0.01))
    east = turn(F.col("lon2") - F.col("lon1"))
    steps = F.greatest(F.ceil(4 * F.greatest(F.abs(F.col("lat2") - F.col("lat1")), F.abs(east)) / high), F.lit(1)).cast("int")
    along = segments.withColumn("__n", steps).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    along = along.withColumns({"__y": F.col("lat1") + (F.col("lat2") - F.col("lat1")) * F.col("__i") / F.col("__n"), "__x": F.col("lon1") + east * F.col("__i") / F.col("__n")})
    # what lies near the date line is listed on both sides of it
    along = along.withColumn("__x", F.explode(F.transform(F.array(*[F.lit(d) for d in (-360, 0, 360)]), lambda d: F.col("__x") + d)))
    along = along.where(F.abs("__x") <= 180 + 2 * wide(F.col("__y")))
    # widths belong to whole degrees of latitude; a segment near an edge is listed under both
    along = along.withColumn("__d", F.explode(F.array_distinct(F.array(F.floor(F.col("__y") - high), F.floor("__y"), F.floor(F.col("__y") + high)))))
    cells = along.withColumns({"__cy": F.floor(F.col("__y") / high).cast("long"), "__cx": F.floor(F.col("__x") / wide(F.col("__d"))).cast("long")}).drop("__y", "__x", "__i", "__n").distinct()
    step = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    around = places.withColumn("__d", F.floor("lat")).withColumn("__s", F.explode(step))
    around = around.withColumns({"__cy": F.floor(F.col("lat") / high).cast("long") + F.col("__s.a"), "__cx": F.floor(F.col("lon") / wide(F.col("__d"))).cast("long") + F.col("__s.b")}).drop("__s")
    pairs = around.join(cells, ["__d", "__cy", "__cx"])
    metre = F.lit(KM_A_DEGREE * 1000)
    shrink = F.cos(F.radians("lat"))
    dx, dy = east * shrink * metre, (F.col("lat2") - F.col("lat1")) * metre
    px, py = turn(F.col("lon") - F.col("lon1")) * shrink * metre, (F.col("lat") - F.col("lat1")) * metre
    length = dx * dx + dy * dy
    share = F.when(length > 0, F.least(F.greatest((px * dx + py * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    found = pairs.withColumn("share", share)
    found = found.withColumn("metres", F.sqrt(F.pow(px - F.col("share") * dx, 2) + F.pow(py - F.col("share") * dy, 2))).where(F.col("metres") <= reach_m)
    cost = F.col("metres") + F.when(F.col("__fast"), penalty_m).otherwise(0.0)
    best = found.groupBy("lat", "lon").agg(F.min(F.struct(cost.alias("cost"), "seg", "share", "metres")).alias("__b"))
    met = points.join(best, ["lat", "lon"])
    ranked = met.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__b.cost", "__b.seg"))).where("__r = 1")
    return ranked.select(*points.columns, "__b.seg", "__b.share", "__b.metres")


def grid_graph(spark: SparkSession, n: int) -> DataFrame:
    """Directed edges (src, dst, cost, access) of an n x n grid with deterministic costs; access is a bit mask 1|2|4."""
    at = spark.range(n * n).select(F.col("id").alias("src"), (F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    step = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    moved = at.withColumn("d", F.explode(step)).withColumns({"x2": F.col("x") + F.col("d.dx"), "y2": F.col("y") + F.col("d.dy")}).where(f"x2 >= 0 AND x2 < {n} AND y2 >= 0 AND y2 < {n}")
    dst = F.col("y2") * n + F.col("x2")
    return moved.select("src", dst.cast("long").alias("dst"), (1 + (F.col("src") * 7 + dst * 13) % 10).cast("long").alias("cost"), F.when((F.col("src") + dst) % 11 == 0, 4).otherwise(7).alias("access"))


#: Labels from which on a round of `shortest` goes one step only.
WIDE = 50_000


def shortest(edges: DataFrame, sources: DataFrame, ceiling: int | None = None, hops: int = 4) -> DataFrame:
    """(source, node, cost, via): least cost from every source to every node within the ceiling, and the node before.

    Each round relaxes only the edges of the nodes that got cheaper in the last one, `hops` steps far, and writes
    only what is cheaper than before; of equal costs the smaller node before stays. More steps a round make
    fewer rounds and relax some edges more than once, so a round that begins with more than WIDE labels goes one step. Costs
    must not be negative.
    """
    nothing = F.lit(None).cast("long")
    front = kept(sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("cost"), nothing.alias("via")))
    # read in every step, so a table of its own
    ahead = kept(edges.select("src", F.col("dst").alias("to"), F.col("cost").alias("more")))
    parts, wide = [front], False
    while True:
        best = reduce(DataFrame.unionByName, parts).groupBy("source", "node").agg(F.min("cost").alias("old"))
        step, steps = front.select("source", "node", "cost"), []
        for _ in range(1 if wide else hops):
            reached = step.join(ahead, step.node == ahead.src).select("source", F.col("to").alias("node"), F.struct((F.col("cost") + F.col("more")).cast("long").alias("cost"), F.col("node").alias("via")).alias("b"))
            if ceiling is not None:
                reached = reached.where(F.col("b.cost") <= ceiling)
            reached = reached.groupBy("source", "node").agg(F.min("b").alias("b"))
            steps.append(reached)
            step = reached.select("source", "node", "b.cost")
        reached = reduce(DataFrame.unionByName, steps).groupBy("source", "node").agg(F.min("b").alias("b"))
        cheaper = reached.join(best, ["source", "node"], "left").where("old IS NULL OR b.cost < old")
        front = kept(cheaper.select("source", "node", "b.cost", "b.via"))
        n = front.count()
        if not n:
            break
        wide = n > WIDE
        parts.append(front)
        if len(parts) == 12:  # so that no round reads more than a dozen tables
            parts = [kept(_least(parts))]
    return _least(parts)


def _least(parts: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, parts).groupBy("source", "node").agg(F.min(F.struct("cost", "via")).alias("b"))
    return every.select("source", "node", "b.cost", "b.via")


def landmarks(edges: DataFrame, number: int = 6) -> DataFrame:
    """(node, there, back): costs from each landmark to a node and from the node to each, null where there is no way.

    Landmarks are the nodes with the smallest hashes. The table serves every search over these edges; make it once.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("source")).distinct()
    chosen = kept(nodes.orderBy(F.xxhash64("source"), "source").limit(number))
    names = [r.source for r in chosen.collect()]  # `number` rows
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
    both = shortest(edges.select("src", "dst", "cost"), chosen).select("node", "source", "cost", F.lit(0).alias("way"))
    both = both.union(shortest(turned, chosen).select("node", "source", "cost", F.lit(1).alias("way")))
    at = lambda way: F.array(*[F.max(F.when((F.col("way") == way) & (F.col("source") == n), F.col("cost"))) for n in names])
    return kept(both.groupBy("node").agg(at(0).alias("there"), at(1).alias("back")))


#: More than any cost: the bound of a node from which the goal can't be reached.
NEVER = 1 << 60


def _bound(there: Column, back: Column, goal_there: Column, goal_back: Column) -> Column:
    """The most that landmarks promise of the way from a node to a goal, by the triangle inequality; NEVER where there is no way.

    The goal is dearer from the landmark than the node, or the node's way to the landmark dearer than the goal's. A landmark that
    reaches the node but not the goal, or is reached from the goal but not from the node, rules a way out.
    """
    ahead = F.transform(F.arrays_zip(there.alias("n"), goal_there.alias("g")), lambda x: F.when(x["n"].isNotNull() & x["g"].isNull(), NEVER).otherwise(x["g"] - x["n"]))
    behind = F.transform(F.arrays_zip(back.alias("n"), goal_back.alias("g")), lambda x: F.when(x["n"].isNull() & x["g"].isNotNull(), NEVER).otherwise(x["n"] - x["g"]))
    return F.greatest(F.coalesce(F.array_max(F.concat(ahead, behind)), F.lit(0)), F.lit(0)).cast("long")


class Goals:
    """Routes of pairs (source, target), steered by landmarks.

    Every label (pair, node) has the cost so far and a lower bound of the rest; their sum can't be more than the
    route through the node. A round relaxes, of each pair, the open labels whose sum is within `slack` of the
    pair's least, so the search runs towards the goal and not around the source. A label whose sum is above
    what is known to suffice (a route found, one through a landmark, the ceiling) is dropped for good. A pair is done
    when no open label's sum is below its route. All pairs take their rounds together, the state of each round
    is a table, and costs are exact. Costs must not be negative; both ends must be known to the landmarks.
    """

    def __init__(self, edges: DataFrame, known: DataFrame):
        self.edges = kept(edges.select("src", "dst", "cost").groupBy("src", "dst").agg(F.min("cost").cast("long").alias("cost")))
        self.known = known
        self.relaxed = 0  # rows of the last search
        self.rounds = 0

    def search(self, pairs: DataFrame, ceiling: int | None = None, slack: float = 0.1, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        """((source, target, cost, state) of every pair, labels). state: found, unreachable, or gave_up after relaxing `most` labels.

        A source that is its target costs 0. Above the ceiling a target counts as unreachable.
        """
        longest = self.edges.agg(F.max("cost")).first()[0] or 0
        pair = ["source", "target"]
        ends = pairs.select(*pair).where("source IS NOT NULL AND target IS NOT NULL").distinct()
        at = lambda name: self.known.select(F.col("node").alias(name), F.col("there").alias(f"{name}_there"), F.col("back").alias(f"{name}_back"))
        both = ends.join(at("source"), "source", "left").join(at("target"), "target", "left")
        through = F.array_min(F.transform(F.arrays_zip(F.col("source_back").alias("a"), F.col("target_there").alias("b")), lambda x: x["a"] + x["b"]))
        enough = F.least(F.coalesce(through, F.lit(NEVER)), F.lit(NEVER if ceiling is None else ceiling)).cast("long")
        least = _bound(F.col("source_there"), F.col("source_back"), F.col("target_there"), F.col("target_back"))
        trips = kept(both.select(*pair, "target_there", "target_back", enough.alias("enough"), least.alias("bound")))
        label = ["node", "cost", "via", "bound", "open", "now"]
        labels = kept(trips.select(*pair, F.col("source").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(None).cast("long").alias("via"), "bound", F.lit(True).alias("open"), F.lit(False).alias("now")))
        total = F.col("cost") + F.col("bound")
        self.relaxed = self.rounds = 0
        while True:
            found = F.min(F.when(F.col("node") == F.col("target"), F.col("cost")))
            state = labels.groupBy(*pair).agg(found.alias("route"), F.min(F.when(F.col("open"), total)).alias("least"), F.count_if(~F.col("open")).alias("closed"), F.count_if("now").alias("moved"))
            state = state.join(trips.drop("bound"), pair).withColumn("enough", F.least("enough", "route"))
            going = F.coalesce((F.col("least") <= F.col("enough")) & (F.col("route").isNull() | (F.col("least") < F.col("route"))), F.lit(False))
            state = state.withColumn("going", going if most is None else going & (F.col("closed") < most))
            seen = state.agg(F.sum("moved").alias("moved"), F.count_if("going").alias("going")).first()
            self.relaxed += seen.moved or 0
            if not seen.going:
                break
            self.rounds += 1
            # how far above the least sum a round reaches: a dearest edge, and a share of the whole
            reach = (F.col("least") * F.lit(1 + slack) + longest).cast("long")
            going_on = state.where("going").select(*pair, F.least(reach, F.col("enough")).alias("reach"), "enough", "target_there", "target_back")
            marked = labels.drop("now").join(going_on, pair, "left").withColumn("now", F.col("open") & F.coalesce(total <= F.col("reach"), F.lit(False)))
            ahead = self.edges.select("src", F.col("dst").alias("to"), F.col("cost").alias("more"))
            steps = marked.where("now").join(ahead, F.col("node") == F.col("src")).withColumn("reached", F.col("cost") + F.col("more"))
            any_of = lambda *names: [F.any_value(n).alias(n) for n in names]
            steps = steps.groupBy(*pair, "to").agg(F.min(F.struct("reached", "node")).alias("b"), *any_of("enough", "target_there", "target_back"))
            rest = _bound(F.col("there"), F.col("back"), F.col("target_there"), F.col("target_back"))
            new = steps.join(self.known.withColumnRenamed("node", "to"), "to", "left").withColumn("bound", rest).where(F.col("b.reached") + F.col("bound") <= F.col("enough"))
            new = new.select(*pair, F.col("to").alias("node"), F.col("b.reached").alias("cost"), F.col("b.node").alias("via"), "bound", F.lit(True).alias("open"), F.lit(False).alias("now"))
            old = marked.withColumn("open", F.col("open") & ~F.col("now")).select(*pair, *label)
            # of equal costs the label that is closed stays closed
            best = old.unionByName(new).groupBy(*pair, "node").agg(F.min(F.struct("cost", "open", "via", "bound")).alias("l"), F.bool_or("now").alias("now"))
            labels = kept(best.select(*pair, "node", "l.*", "now"))
        ended = labels.groupBy(*pair).agg(F.min(F.when(F.col("node") == F.col("target"), F.col("cost"))).alias("cost"), F.min(F.when(F.col("open"), total)).alias("least"), F.count_if(~F.col("open")).alias("closed"))
        out = ends.join(ended, pair, "left")
        short = (F.col("closed") >= most) & (F.col("least") < F.coalesce("cost", F.lit(NEVER))) if most is not None else F.lit(False)
        named = F.when(short, "gave_up").when(F.col("cost") <= (NEVER if ceiling is None else ceiling), "found").otherwise("unreachable")
        return out.withColumn("state", named).select(*pair, F.when(F.col("state") == "found", F.col("cost")).alias("cost"), "state"), labels.select(*pair, "node", "cost", "via")


def paths(costs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, cost, path) of pairs (source, target): nodes from the source to the target, walked back by `via`; null if unreachable.

    costs are those of `shortest`, or labels of `Goals`, which belong to a pair each.
    """
    key = [c for c in ("source", "target") if c in costs.columns]
    ends = costs.where("node = target").drop("node") if "target" in key else costs.withColumnRenamed("node", "target")
    found = pairs.select("source", "target").distinct().join(ends, ["source", "target"], "left")
    state = kept(found.select("source", "target", "cost", F.when(F.col("cost").isNotNull(), F.array("target")).alias("path"), F.col("via").alias("at")))
    done = []
    while True:
        ended = state.where("at IS NULL").drop("at")
        done.append(ended)
        open_ = state.where("at IS NOT NULL")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        before = costs.select(*key, F.col("node").alias("at"), F.col("via").alias("next"))
        state = kept(open_.join(before, [*key, "at"]).select("source", "target", "cost", F.concat(F.array("at"), "path").alias("path"), F.col("next").alias("at")))


def route(edges: DataFrame, trips: DataFrame, budget: int) -> DataFrame:
    """(trip, cost, path, state) of trips (trip, stops): the legs between stops in order, joined where they meet.

    state: ok, too_far (more than the budget in all), unreachable, or bad_request for fewer than two stops.
    """
    legs = trips.where(F.size("stops") >= 2).select("trip", F.posexplode(F.slice("stops", F.lit(1), F.size("stops") - 1)).alias("leg", "source"), "stops")
    legs = legs.select("trip", "leg", "source", F.get("stops", F.col("leg") + 1).alias("target"))
    costs = kept(shortest(edges, legs.select("source").distinct(), budget))
    walked = legs.join(paths(costs, legs), ["source", "target"], "left")
    gathered = walked.groupBy("trip").agg(F.sum("cost").alias("cost"), F.bool_or(F.col("cost").isNull()).alias("broken"), F.array_sort(F.collect_list(F.struct("leg", "path"))).alias("all"))
    joined = F.aggregate("all", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.when(F.size(acc) > 0, F.slice(x["path"], F.lit(2), F.size(x["path"]))).otherwise(x["path"])))
    state = F.when(F.col("cost").isNull() & F.col("broken").isNull(), "bad_request").when(F.col("broken"), "unreachable").when(F.col("cost") > budget, "too_far").otherwise("ok")
    out = trips.select("trip").join(gathered, "trip", "left").withColumn("state", state)
    fine = F.col("state") == "ok"
    return out.select("trip", F.when(fine, F.col("cost")).alias("cost"), F.when(fine, joined).alias("path"), "state")


def travel_minutes(costs: DataFrame, factor: float, ceiling: int) -> DataFrame:
    """Seconds to whole minutes, at least 1, after a correction factor; beyond the ceiling is unreachable."""
    minutes = F.greatest(F.floor(F.col("cost") * F.lit(factor) / 60 + 0.5), F.lit(1)).cast("int")
    return costs.withColumn("minutes", minutes).where(F.col("minutes") <= ceiling)


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node): everything that can be reached from the start nodes, by rounds over the frontier."""
    seen = kept(start.select("node").distinct())
    front = seen
    while True:
        new = kept(front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if new.isEmpty():
            return seen
        seen, front = kept(seen.union(new)), new


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the largest node that reaches it, by rounds over what changed."""
    colours = kept(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
    front = colours
    while True:
        new = front.join(edges, front.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
        merged = kept(colours.join(new, "node", "left").select("node", F.greatest("colour", "new").alias("colour"), F.coalesce(F.col("new") > F.col("colour"), F.lit(False)).alias("moved")))
        colours, front = merged.select("node", "colour"), merged.where("moved").select("node", "colour")
        if front.isEmpty():
            return colours


def largest_strong_component(edges: DataFrame) -> DataFrame:
    """(node) of the largest strongly connected component, of equal ones that of the largest node.

    Every node takes the colour of the largest node that reaches it. What reaches that node within its
    colour is its component, so each round finds one component of every colour; no component spans two
    colours. Rounds go on until no colour's remaining nodes can be more than the best component.
    """
    left = kept(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    best, size, root = None, 0, None
    while not left.isEmpty():
        colours = _coloured(left)
        inside = left.join(colours.withColumnRenamed("node", "src"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other")
        inside = kept(inside.select("src", "dst"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = kept(reachable(back, colours.where("node = colour").select("node")).join(colours, "node"))
        top = found.groupBy("colour").count().orderBy(F.desc("count"), F.desc("colour")).first()
        if (top["count"], top["colour"]) > (size, root):
            best, size, root = found.where(F.col("colour") == top["colour"]).select("node"), top["count"], top["colour"]
        rest = colours.join(found, "node", "left_anti")
        open_ = rest.groupBy("colour").count().where(F.col("count") >= size)
        rest = kept(rest.join(open_, "colour", "left_semi").select("node"))
        left = kept(inside.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return best if best is not None else edges.select(F.col("src").alias("node")).limit(0)


def ways_to_edges(ways: DataFrame, speeds: dict[str, int], default: int) -> DataFrame:
    """Directed edges of ways (way, kind, nodes array, oneway, maxspeed): consecutive nodes, both directions unless one-way."""
    table = F.create_map(*[x for k, v in speeds.items() for x in (F.lit(k), F.lit(v))])
    speed = F.coalesce(F.regexp_extract("maxspeed", r"^(\d+)", 1).try_cast("int"), table[F.col("kind")], F.lit(default))
    pairs = ways.withColumn("__i", F.explode(F.sequence(F.lit(1), F.greatest(F.size("nodes") - 1, F.lit(1))))).where(F.size("nodes") > 1)
    ahead = pairs.select("way", F.element_at("nodes", F.col("__i")).alias("src"), F.element_at("nodes", F.col("__i") + 1).alias("dst"), speed.alias("speed"), F.coalesce("oneway", F.lit(False)).alias("oneway"))
    back = ahead.where(~F.col("oneway")).select("way", F.col("dst").alias("src"), F.col("src").alias("dst"), "speed", "oneway")
    return ahead.union(back).drop("oneway")

"""Measures of detectors and classifiers: intervals, confusion, calibration, thresholds, boxes, linear heads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end; 0 and 1 without trials."""
    p = successes / F.nullif(n, F.lit(0)).cast("double")
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.coalesce(F.greatest(F.lit(0.0), (centre - spread) / scale), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), (centre + spread) / scale), F.lit(1.0))


def outcome_by_kind(rows: DataFrame) -> DataFrame:
    """Per kind: rows, answered and right answers, with Wilson intervals of the share that is right."""
    df = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("predicted").alias("answered"), F.count_if(F.col("predicted") == F.col("truth")).alias("right"))
    low, high = wilson(F.col("right"), F.col("n"))
    return df.withColumn("low", low).withColumn("high", high)


def confusion(rows: DataFrame) -> DataFrame:
    """Counts by truth and prediction, -1 for unknown."""
    return rows.groupBy("truth", F.coalesce("predicted", F.lit(-1)).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class(rows: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of each class; null where undefined, F1 also where precision or recall is 0.

    Each row counts once for its truth and once for its prediction, so all classes are summed in one pass.
    """
    a = rows.select(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("truth") == F.col("predicted")).cast("int").alias("hit"))
    b = rows.filter("predicted IS NOT NULL").select(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit"))
    df = a.unionByName(b).groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("named"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    df = df.withColumn("precision", F.try_divide(F.col("hits").cast("double"), F.col("named"))).withColumn("recall", F.try_divide(F.col("hits").cast("double"), F.col("support")))
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return df.select("label", "support", "precision", "recall", f1.alias("f1"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins that hold their upper end; a confidence of 0 is in none."""
    df = rows.filter("confidence > 0 AND predicted IS NOT NULL").withColumn("bin", F.ceil(F.col("confidence") * bins))
    per = df.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("a"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("error"))


def threshold_table(rows: DataFrame, steps: int = 20) -> DataFrame:
    """For each threshold the rows answered and those right among them. Counts are summed by step first, then over the steps above."""
    at = F.floor(F.col("confidence") * steps).cast("long")
    per = rows.filter("predicted IS NOT NULL").groupBy(at.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("truth")).alias("right"))
    grid = rows.sparkSession.range(steps + 1).withColumnRenamed("id", "t")
    df = grid.join(F.broadcast(per.filter(F.col("step") <= steps)), F.col("step") >= F.col("t"), "left")
    return df.groupBy("t").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("answered"), F.coalesce(F.sum("right"), F.lit(0)).alias("right"))


def pick_threshold(table: DataFrame, total: int, accuracy: float, coverage: float = 0.5) -> DataFrame:
    """The lowest threshold from which those answered are right often enough while enough are answered."""
    ok = (F.col("answered") >= coverage * total) & (F.col("right") >= accuracy * F.col("answered"))
    return table.filter(ok).agg(F.min("t").alias("t"))


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes given by the prefixes of x1, y1, x2, y2, over what they cover together."""
    c = lambda p, k: F.col(f"{p}{k}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda p: (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1"))
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def visible(boxes: DataFrame) -> DataFrame:
    """Boxes clipped to the unit square; those with less than half of their area inside go."""
    clip = lambda k: F.greatest(F.lit(0.0), F.least(F.col(k), F.lit(1.0)))
    df = boxes.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    df = df.select("image", "box", "label", *[clip(k).alias(k) for k in ("x1", "y1", "x2", "y2")], "score", "area")
    return df.filter((F.col("area") > 0) & ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= 0.5 * F.col("area"))).drop("area")


def overlap(a: Column, b: Column) -> Column:
    """What two boxes (structs with x1, y1, x2, y2) cover both, over what they cover together."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-12))


def _best_first(boxes: DataFrame) -> Column:
    """All boxes of a group as one array of structs, highest scores first, then by box and corner; boxes without a score come last."""
    first = [F.col("score").isNull().alias("s0_"), (-F.col("score")).alias("s1_")]
    return F.array_sort(F.collect_list(F.struct(*first, "box", "x1", "y1", *[c for c in boxes.columns if c not in ("box", "x1", "y1")])))


def suppress(boxes: DataFrame, limit: float = 0.45) -> DataFrame:
    """Non-maximum suppression in each image and label: by score, a box stays if it overlaps none kept by more than the limit.

    Each group's boxes are folded in order into those kept, so the work of a group grows with its boxes times those kept.
    """
    groups = boxes.groupBy("image", "label").agg(_best_first(boxes).alias("all_"))
    kept = F.aggregate("all_", F.slice("all_", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: overlap(k, b) > limit), kept).otherwise(F.concat(kept, F.array(b))))
    return groups.select(F.explode(kept).alias("b_")).select(*[F.col(f"b_.{c}") for c in boxes.columns])


SIDES = ("x1", "y1", "x2", "y2")
#: Overlaps that are held at once while an image is matched.
OVERLAPS = 1 << 15


def overlaps(found: np.ndarray, truth: np.ndarray, absent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``overlap`` of boxes (a row each of x1, y1, x2, y2), found by true; ``absent`` tells which sides are null, which NaN stands for."""
    (f, t), (no_f, no_t) = (x.T[..., None] for x in (found, truth)), (x.T[..., None] for x in absent)
    nulls = no_f.any() or no_t.any()

    def both(low: int, high: int) -> np.ndarray:
        ends = (f[low], t[low]) if not nulls else (np.where(no_f[low], -np.inf, f[low]), np.where(no_t[low], -np.inf, t[low]))
        side = np.fmin(f[high], t[high].T)
        side -= np.maximum(ends[0], ends[1].T)
        np.maximum(0.0, side, out=side)
        if nulls:
            side[(no_f[low] & no_t[low].T) | (no_f[high] & no_t[high].T)] = 0.0
        return side

    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    shared = both(0, 2)
    shared *= both(1, 3)
    all_ = area(f) + area(t).T
    all_ -= shared
    np.maximum(all_, 1e-12, out=all_)
    if nulls:
        all_[no_f.any(axis=0) | no_t.any(axis=0).T] = 1e-12
    shared /= all_
    return shared


@np.errstate(invalid="ignore")
def hits(found: np.ndarray, truth: np.ndarray, absent: tuple[np.ndarray, np.ndarray], least: float) -> int:
    """How many found boxes, in their order, take a free true one: that of most overlap, ``least`` or more, the first of equals. NaN is most."""
    free, block, taken = np.ones(len(truth), bool), max(1, OVERLAPS // max(1, len(truth))), 0
    for at in range(0, len(found) if len(truth) else 0, block):
        v = overlaps(found[at : at + block], truth, (absent[0][at : at + block], absent[1]))
        v[np.isnan(v)] = np.inf  # overlaps are finite but for NaN, or what comes of infinite sides
        rows, columns = np.divmod(np.flatnonzero(v >= least), len(truth))
        ends = np.searchsorted(rows, np.arange(len(v) + 1))
        for i in np.flatnonzero(np.diff(ends)):
            some = columns[ends[i] : ends[i + 1]]
            some = some[free[some]]
            if len(some):
                free[some[v[i, some].argmax()]] = False
                taken += 1
    return taken


def match_boxes(found: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(image, hits, extra, missed): found boxes, best score first, each take the free true box that they overlap most, the first of equals
    by box. Boxes of both kinds are shuffled by image and sorted once, and each image is matched as its rows pass, in blocks of overlaps."""
    kind = found.schema["image"].dataType.simpleString()
    rest = [c for c in found.columns if c not in ("image", "box", *SIDES, "score")]
    order = ["unscored_", "low_", "box", "x1", "y1", *[f"{c}_" for c in rest], "x2", "y2"]
    sides = [F.col(c).cast("double").alias(c) for c in SIDES]
    a = found.select("image", F.lit(0).alias("kind_"), F.col("score").isNull().alias("unscored_"), (-F.col("score")).cast("double").alias("low_"), "box", *sides, *[F.col(c).alias(f"{c}_") for c in rest])
    b = truth.select("image", F.lit(1).alias("kind_"), F.lit(False).alias("unscored_"), F.lit(None).cast("double").alias("low_"), "box", *sides, *[F.lit(None).cast(found.schema[c].dataType).alias(f"{c}_") for c in rest])
    rows = a.unionByName(b).repartition("image").sortWithinPartitions("image", "kind_", *order).select("image", "kind_", *SIDES)

    def judged(parts: list[pa.RecordBatch]) -> tuple[int, int, int]:
        columns = [np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("kind_", *SIDES)]
        absent = np.stack([np.concatenate([p.column(c).is_null().to_numpy(zero_copy_only=False) for p in parts]) for c in SIDES], axis=1)
        boxes, true = np.stack(columns[1:], axis=1), columns[0] == 1
        n = hits(boxes[~true], boxes[true], (absent[~true], absent[true]), least)
        return n, int((~true).sum()) - n, int(true.sum()) - n

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one image, and of one kind where the image is null, follow each other; the last ones of a batch wait for the next."""
        key, held = None, []
        for batch in batches:
            out = []
            place = batch.schema.get_field_index("image")
            ends = pa.compute.run_end_encode(batch.column(place))
            kinds = batch.column("kind_").to_numpy()
            start = 0
            for image, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
                cut = start + int(np.searchsorted(kinds[start:end], 1)) if image is None else end
                for frm, to in ((start, cut), (cut, end)):
                    if frm < to:
                        own = (image, int(kinds[frm]) if image is None else -1)
                        if held and own != key:
                            out.append((key[0], *judged(held)))
                            held = []
                        key = own
                        held.append(batch.slice(frm, to - frm))
                start = end
            if out:
                yield result(out, batch.schema.field(place).type)
        if held:
            yield result([(key[0], *judged(held))], held[0].schema.field("image").type)

    def result(out: list[tuple], image: pa.DataType) -> pa.RecordBatch:
        images, *counts = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(images, image), *[pa.array(c, pa.int64()) for c in counts]], ["image", "hits", "extra", "missed"])

    return rows.mapInArrow(matched, f"image {kind}, hits long, extra long, missed long")


def image_level(rows: DataFrame, threshold: float) -> DataFrame:
    """Counts and rates of images called positive from a threshold; null where a rate is undefined."""
    called, true = F.col("confidence") >= threshold, F.col("truth") == 1
    df = rows.agg(F.count_if(called & true).alias("tp"), F.count_if(called & ~true).alias("fp"), F.count_if(~called & true).alias("fn"), F.count_if(~called & ~true).alias("tn"))
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    return df.select("*", d("tp", F.col("tp") + F.col("fp")).alias("precision"), d("tp", F.col("tp") + F.col("fn")).alias("recall"), d("fp", F.col("fp") + F.col("tn")).alias("false_alarms"))


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def softmax(v: Column) -> Column:
    raised = lambda m: F.transform(v, lambda x: F.exp(x - m))
    shares = lambda t: F.transform(t["e"], lambda x: x / t["s"])
    summed = lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda s, x: s + x).alias("s"))
    return once(once(once(F.array_max(v), raised), summed), shares)


def class_centres(embeddings: DataFrame) -> DataFrame:
    """The mean embedding of each label, by position, without gathering the vectors."""
    parts = embeddings.select("label", F.posexplode("embedding").alias("at", "x"))
    return parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))


def linear_head(embeddings: DataFrame, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0) -> DataFrame:
    """Label and probability of each normalised embedding under a linear head; -1 below the threshold. The head is a fixed, small matrix."""

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["embedding"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, weights.shape[1]))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            z = (x @ weights.T + bias) / temperature
            e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
            p = e / e.sum(axis=1, keepdims=True) if len(z) else e
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            top = p[np.arange(len(p)), best]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "predicted": np.where(top >= threshold, best, -1), "probability": top})

    return embeddings.select("vec_id", "embedding").mapInPandas(predict, "vec_id long, predicted long, probability double")


def dangerous_by_kind(rows: DataFrame, danger: int = 1) -> DataFrame:
    """Per kind, of the rows that are truly harmless those named the dangerous class; an unknown answer is never dangerous."""
    harmless = rows.filter(F.col("truth") != danger)
    df = harmless.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == danger).alias("wrong"))
    low, high = wilson(F.col("wrong"), F.col("n"))
    return df.withColumn("low", low).withColumn("high", high)


def safe_threshold(rows: DataFrame, budget: float = 0.05, steps: int = 100, danger: int = 1) -> DataFrame:
    """The lowest step at which no kind's dangerous rate is over the budget; null if there is none.

    Errors are summed by kind and step first; a step's errors are those of confidence at or above it.
    """
    step = F.floor(F.col("confidence") * steps).cast("long")
    per = rows.filter(F.col("truth") != danger).groupBy("kind", step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == danger).alias("wrong"))
    w = Window.partitionBy("kind").orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    kinds = per.groupBy("kind").agg(F.sum("n").alias("all"))
    grid = kinds.select("kind", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).alias("t"))
    df = grid.join(per.withColumnRenamed("s", "t"), ["kind", "t"], "left").withColumn("above", F.coalesce(F.sum("wrong").over(w), F.lit(0)))
    return df.groupBy("t").agg(F.max(F.col("above") / F.col("all").cast("double")).alias("worst")).filter(F.col("worst") <= budget).agg(F.min("t").alias("t"))


def log_loss(rows: DataFrame, temperatures: list[float]) -> DataFrame:
    """Mean log loss of (logits, truth) at each temperature, all in one pass."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in temperatures])).alias("temperature")
    with_top = lambda z: F.struct(z.alias("z"), F.array_max(z).alias("top"))
    one = lambda v: F.log(F.aggregate(v["z"], F.lit(0.0), lambda s, x: s + F.exp(x - v["top"]))) + v["top"] - F.get(v["z"], F.col("truth"))
    loss = once(once(F.transform("logits", lambda x: x / F.col("temperature")), with_top), one)
    return rows.select("logits", "truth", t).groupBy("temperature").agg(F.avg(loss).alias("loss"))


def fit_temperature(rows: DataFrame, low: float = 0.05, high: float = 20.0, points: int = 21, rounds: int = 5) -> float:
    """The temperature of least log loss: a grid in the logarithm, narrowed around its best point a few times; one job for each round."""
    a, b = np.log(low), np.log(high)
    for _ in range(rounds):
        grid = np.exp(np.linspace(a, b, points))
        loss = {r["temperature"]: r["loss"] for r in log_loss(rows, grid.tolist()).collect()}  # points rows
        best = min(range(points), key=lambda i: (loss[grid[i]], i))
        a, b = np.log(grid[max(best - 1, 0)]), np.log(grid[min(best + 1, points - 1)])
    return float(np.exp((a + b) / 2))


def group_split(sizes: DataFrame, shares: tuple[float, ...] = (0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """(group, part): whole groups, in an order fixed by seed, each to the part with the most room left.

    Greedy over groups, which are few beside the rows: ``sizes`` has (label, group, n), and labels are split each for itself.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "order"], ascending=[False, True])
        room, part = np.array(shares) * pdf["n"].sum(), []
        for n in pdf["n"]:
            part.append(int(np.argmax(room)))
            room[part[-1]] -= n
        return pdf.assign(part=part)[["label", "group", "part"]]

    df = sizes.withColumn("order", F.xxhash64(F.col("group").cast("string"), F.lit(seed)))
    kinds = {f.name: f.dataType.simpleString() for f in sizes.schema}
    return df.groupBy("label").applyInPandas(one, f"label {kinds['label']}, `group` {kinds['group']}, part int")


def box_level(matches: DataFrame) -> DataFrame:
    """Hits, extra and missed boxes of all images, with precision and recall; null where a rate is undefined."""
    df = matches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "extra", "missed")])
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    return df.select("*", d("hits", F.col("hits") + F.col("extra")).alias("precision"), d("hits", F.col("hits") + F.col("missed")).alias("recall"))


def recall_by_category(images: DataFrame, found: DataFrame, least: float = 0.2) -> DataFrame:
    """Per category of images (image, category): how many there are and the share with a box of enough confidence; 3 places."""
    seen = found.filter(F.col("score") >= least).select("image").distinct().withColumn("found", F.lit(True))
    df = images.join(seen, "image", "left").groupBy("category").agg(F.count(F.lit(1)).alias("images"), F.count_if("found").alias("hits"))
    return df.select("category", "images", F.round(F.col("hits") / F.col("images").cast("double"), 3).alias("recall"))


def throughput(runs: DataFrame, seconds: str) -> DataFrame:
    """Items a second and the median milliseconds of an item, from the seconds that each took."""
    df = runs.agg(F.count(F.lit(1)).alias("items"), F.sum(seconds).alias("total"), F.median(seconds).alias("middle"))
    return df.select("items", F.round(F.try_divide(F.col("items").cast("double"), F.col("total")), 2).alias("per_second"), F.round(F.col("middle") * 1000, 1).alias("median_ms"))


def majority_baseline(rows: DataFrame, label: str) -> DataFrame:
    """The share of the most frequent class: what always naming it would get right."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n").alias("most"), F.sum("n").alias("rows")).select("most", "rows", F.try_divide(F.col("most").cast("double"), F.col("rows")).alias("share"))


def outcome_shares(outcomes: DataFrame) -> DataFrame:
    """Per kind the shares named rightly, named wrongly and left unknown (columns n, answered, right)."""
    share = lambda c: F.try_divide(c.cast("double"), F.col("n"))
    return outcomes.select("kind", share(F.col("right")).alias("named_right"), share(F.col("answered") - F.col("right")).alias("named_wrong"), share(F.col("n") - F.col("answered")).alias("unknown"))


def observer_hash(user: Column) -> Column:
    """Twelve hex digits that stand for an observer."""
    return F.substring(F.sha2(F.concat(F.lit("observer:"), user.cast("string")), 256), 1, 12)


def postprocessed(boxes: DataFrame, logit: str, least: float = 0.2, limit: float = 0.45, most: int = 300) -> DataFrame:
    """A detector's raw boxes of each image: scores from logits, those above ``least``, suppressed by label, the best ``most``, clipped."""
    df = boxes.withColumn("score", 1 / (1 + F.exp(-F.col(logit)))).filter(F.col("score") > least)
    kept = suppress(df.select("image", "box", "label", "x1", "y1", "x2", "y2", "score"), limit)
    w = Window.partitionBy("image").orderBy(F.desc("score"), "box")
    return visible(kept.withColumn("place_", F.row_number().over(w)).filter(F.col("place_") <= most).drop("place_"))


def named_animals(boxes: DataFrame, least: float = 0.2, animal: int = 0) -> DataFrame:
    """Boxes of enough confidence, and whether the namer sees them: animals only, never people or vehicles."""
    return boxes.filter(F.col("score") >= least).withColumn("to_name", F.col("label") == animal)


def model_versions(reports: DataFrame) -> DataFrame:
    """(name, task, metrics) from (name, task, report): of an evaluation report in JSON the parts that a stored version shows."""
    get = lambda path: F.get_json_object("report", f"$.{path}")
    parts = {
        "classes": get("classes"), "split": get("split"), "chosen": get("chosen"), "test_photos": get("results.test.photos"), "answered": get("results.test.answered"),
        "accuracy_when_answered": get("results.test.accuracy_when_answered"), "majority_class_baseline": get("majority_class_baseline"), "per_class": get("results.test.per_class"),
    }
    return reports.select("name", "task", F.map_filter(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()).alias("metrics"))


def fit_head(train: DataFrame, validation: DataFrame, penalties: tuple[float, ...] = (0.0, 0.001, 0.01, 0.1), rounds: int = 100):
    """The logistic regression of (embedding, label) whose penalty has the least log loss on the validation rows; (model, penalty, losses)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    shaped = lambda df: df.select(array_to_vector(l2_normalised(F.col("embedding"))).alias("features"), F.col("label").cast("double").alias("label"))
    a, b, losses, models = shaped(train), shaped(validation), {}, {}
    for c in penalties:  # a few fits over the same rows
        models[c] = LogisticRegression(regParam=c, maxIter=rounds).fit(a)
        p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
        losses[c] = models[c].transform(b).agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15))))).first()[0]
    best = min(penalties, key=lambda c: losses[c])
    return models[best], best, losses

"""Label files aligned with page images by mutual best match of names.

Only pairs of one year are scored; pairs of different years, and those of rows without a year, score 0. Of these, each
side needs no more than its first three in order, which come from six rows at most, so the full product of both sides
is never made. Where only the best of each side are wanted, the different names and titles of a year meet in blocks: the
longest common subsequence bounds the similarity, and the sequence matcher runs only on pairs whose bound reaches the best
found so far.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridmark.functions.names import easy_similarity, normal_name, ratcliff_ratio, round4, title_key
from gridmark.functions.subsequence import Titles

TOP, TASKS = 3, 10_000
#: Labels of a block, titles of a block in blocks of labels, pairs that are bounded at once, matchers that are kept.
BLOCK, WIDTH, PAIRS, HELD = 512, 128, 2**20, 4096
SCORES = ("score", "station_similarity", "river_similarity", "combined_similarity")
MIN_SCORE, MIN_CSV_MARGIN, MIN_IMAGE_MARGIN = 95.0, 8.0, 8.0


def _fillers(side: DataFrame, pos: str) -> DataFrame:
    """Rows that hold, for any year, the first TOP of the other years: 2 * TOP at most."""
    per_year = Window.partitionBy("year").orderBy(pos)
    return side.withColumn("__r", F.row_number().over(per_year)).filter(F.col("__r") <= TOP).drop("__r").orderBy(pos).limit(2 * TOP)


def _pair_scores(pairs: DataFrame) -> DataFrame:
    """station_similarity, river_similarity, combined_similarity, score for pairs of one year."""
    sides = {"station": F.col("station_key"), "river": F.col("river_key"), "combined": F.concat("river_key", "station_key")}
    title = F.col("title_key")
    rows = pairs.withColumns({f"{k}_similarity": easy_similarity(v, title) for k, v in sides.items()})
    # Only what is open is sent to the sequence matcher; it gets nulls for the rest.
    for k, v in sides.items():
        name = f"{k}_similarity"
        open_ = F.col(name).isNull()
        rows = rows.withColumn(name, F.coalesce(name, ratcliff_ratio(F.when(open_, v), F.when(open_, title))))

    combined = sides["combined"]
    holds = lambda part: F.contains(title, part)
    bonus = F.when(combined == title, 30.0).when(holds(combined), 20.0).otherwise(0.0)
    score: Column = F.col("combined_similarity") * 70.0 + F.col("station_similarity") * 45.0 + F.col("river_similarity") * 25.0 + bonus
    for key, points in (("station_key", 20.0), ("river_key", 10.0)):
        score = score + F.when((F.col(key) != "") & holds(F.col(key)), points).otherwise(0.0)
    score = score + F.when(F.endswith(title, F.col("station_key")), 5.0).otherwise(0.0)
    return rows.withColumn("score", round4(score)).withColumns({f"{k}_similarity": round4(f"{k}_similarity") for k in sides})


def _keyed(csvs: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their keys; a missing year is one that the other side doesn't have."""
    year = lambda side: F.coalesce(F.col("year").cast("string"), F.lit(f"\x00{side}")).alias("year")
    text = lambda c: F.coalesce(c, F.lit(""))
    left = csvs.select("csv_pos", year("label"), text(normal_name("station_name")).alias("station_key"), text(normal_name("river")).alias("river_key"))
    return left, images.select("image_pos", year("image"), text(title_key("title_text")).alias("title_key"))


def _apart(left: DataFrame, right: DataFrame, of_images: bool = True) -> DataFrame:
    """The pairs of different years that can be among the first TOP of either side, or of labels only; they score 0."""
    few_images = F.broadcast(_fillers(right, "image_pos").select("image_pos", F.col("year").alias("y2")))  # 6 rows at most
    apart = left.select("csv_pos", "year").join(few_images, F.col("year") != F.col("y2")).select("csv_pos", "image_pos")
    if of_images:
        few_csvs = F.broadcast(_fillers(left, "csv_pos").select("csv_pos", F.col("year").alias("y2")))  # 6 rows at most
        apart = apart.unionByName(right.select("image_pos", "year").join(few_csvs, F.col("year") != F.col("y2")).select("csv_pos", "image_pos"))
    return apart.distinct().withColumns({c: F.lit(0.0) for c in SCORES})


def match_candidates(csvs: DataFrame, images: DataFrame) -> DataFrame:
    """csv_pos, image_pos, score and similarities of every pair of one year, and of those others that can be among the best.

    csvs: csv_pos, station_name, river, year. images: image_pos, title_text, year. Years are text.
    """
    left, right = _keyed(csvs, images)
    scored = _pair_scores(left.join(right, "year")).select("csv_pos", "image_pos", *SCORES)
    return scored.unionByName(_apart(left, right))


class _Cell:
    """Labels and titles of a block: exact scores on demand, and bounds of them for all pairs."""

    def __init__(self, stations: list[str], rivers: list[str], titles: list[str]):
        self.stations, self.rivers, self.both = stations, rivers, [r + s for r, s in zip(rivers, stations, strict=True)]
        self.titles = titles
        self.matchers: dict[int, SequenceMatcher] = {}
        self.known: dict[tuple[str, int], float] = {}
        self.scored: dict[tuple[int, int], tuple[float, ...]] = {}

    def bounds(self, labels: slice, titles: Titles) -> np.ndarray:
        """For each label and title a score that theirs doesn't exceed, in the same order of operations as the score."""
        sides = self.stations[labels], self.rivers[labels], self.both[labels]
        place = {key: k for k, key in enumerate(dict.fromkeys(x for side in sides for x in side))}
        common, sizes = titles.common(list(place)), titles.sizes
        out = np.empty((len(sides[0]), len(sizes)))
        for k, (station, river, both) in enumerate(zip(*sides, strict=True)):
            # What the sequence matcher finds is a common subsequence. One inside the other scores the share of lengths, which is less than the ratio.
            s, r, c = ((common[place[x]], len(x)) for x in (station, river, both))
            ratio = lambda side: 2.0 * side[0] / np.maximum(1, side[1] + sizes)
            extra = np.where(c[0] >= c[1], np.where(sizes == c[1], 30.0, 20.0), 0.0)
            extra += np.where(s[0] >= s[1], 25.0 if station else 5.0, 0.0)
            by_station = ratio(s)
            out[k] = (by_station if station == both else ratio(c)) * 70.0 + by_station * 45.0
            if river:
                out[k] += ratio(r) * 25.0
                extra += np.where(r[0] >= r[1], 10.0, 0.0)
            out[k] += extra
        return out

    def similarity(self, key: str, t: int) -> float:
        title = self.titles[t]
        if not key or not title:
            return 0.0
        if key == title:
            return 1.0
        if key in title or title in key:
            return min(len(key), len(title)) / max(len(key), len(title))
        if (found := self.known.get((key, t))) is None:
            if (matcher := self.matchers.get(t)) is None:
                if len(self.matchers) >= HELD:
                    self.matchers.clear()
                    self.known.clear()
                matcher = self.matchers[t] = SequenceMatcher(None, "", title)
            matcher.set_seq1(key)
            found = self.known[key, t] = matcher.ratio()
        return found

    def score(self, k: int, t: int) -> tuple[float, ...]:
        """score and the similarities of station, river and both, by four digits."""
        if (found := self.scored.get((k, t))) is None:
            station, river, both, title = self.stations[k], self.rivers[k], self.both[k], self.titles[t]
            s, r, c = (self.similarity(x, t) for x in (station, river, both))
            extra = 30.0 if both == title else 20.0 if both in title else 0.0
            extra += 20.0 * bool(station and station in title) + 10.0 * bool(river and river in title) + 5.0 * title.endswith(station)
            found = self.scored[k, t] = tuple(round(x, 4) for x in (c * 70.0 + s * 45.0 + r * 25.0 + extra, s, r, c))
        return found

    def best_of_labels(self, top: int) -> set[tuple[int, int]]:
        """The first ``top`` titles of each label; the earlier of equal ones."""
        titles, step = Titles(self.titles), max(1, PAIRS // len(self.titles))
        found = set()
        for start in range(0, len(self.stations), step):
            for k, row in enumerate(self.bounds(slice(start, start + step), titles), start):
                found |= {(k, t) for t in _first(row, top, lambda t, k=k: self.score(k, t)[0])}
        return found

    def best_of_titles(self, top: int) -> set[tuple[int, int]]:
        """The first ``top`` labels of each title; the earlier of equal ones."""
        step = max(1, PAIRS // len(self.stations))
        found = set()
        for start in range(0, len(self.titles), step):
            bounds = self.bounds(slice(None), Titles(self.titles[start : start + step]))
            for t, row in enumerate(np.ascontiguousarray(bounds.T), start):
                found |= {(k, t) for k in _first(row, top, lambda k, t=t: self.score(k, t)[0])}
        return found


def _first(bounds: np.ndarray, top: int, score) -> list[int]:
    """The places of the ``top`` highest scores, the earlier of equal ones. Only those are scored whose bound can be among them."""
    best: list[tuple[float, int]] = []
    places = np.arange(len(bounds))
    while len(places):
        highest = bounds.max()
        whole = round(float(highest), 4)
        if len(best) == top and whole < -best[-1][0]:
            break
        level = bounds == highest
        for t in places[level].tolist():
            if len(best) == top and (-whole, t) > best[-1]:
                break
            best = sorted([*best, (-score(t), t)])[:top]
        # A bound of the same four digits as the last score stays, one of a lower score goes.
        kept = ~level if len(best) < top else ~level & (bounds > -best[-1][0] - 1e-3)
        places, bounds = places[kept], bounds[kept]
    return [t for _, t in best]


_CELL = ("way", "year", "station_key", "river_key", "csv_pos", "title_key", "image_pos", *SCORES)
_CELL_TYPES = "way int, year string, station_key string, river_key string, csv_pos long, title_key string, image_pos long, " + ", ".join(f"{c} double" for c in SCORES)
_NONE = -(2**63)  # in place of a missing position, so that pandas keeps whole numbers


def _best_of_cell(per_label: int, per_image: int):
    def run(labels: pd.DataFrame, images: pd.DataFrame) -> pd.DataFrame:
        if labels.empty or images.empty:
            return pd.DataFrame([], columns=_CELL)
        names: dict[tuple[str, str], list[int]] = {}
        titles: dict[str, list[int]] = {}
        for station, river, pos in labels.sort_values("csv_pos")[["station_key", "river_key", "csv_pos"]].itertuples(index=False):
            names.setdefault((station, river), []).append(pos)
        for title, pos in images.sort_values("image_pos")[["title_key", "image_pos"]].itertuples(index=False):
            titles.setdefault(title, []).append(pos)
        cell = _Cell([s for s, _ in names], [r for _, r in names], list(titles))
        found = cell.best_of_labels(per_label) | (cell.best_of_titles(per_image) if per_image else set())
        year, keys, out = labels["of_year"].iloc[0], list(names), []
        for k, t in sorted(found):
            title, scores = cell.titles[t], cell.score(k, t)
            out += [(0, year, *keys[k], _NONE, title, pos, *scores) for pos in titles[title][:per_label]]
            out += [(1, year, *keys[k], pos, title, _NONE, *scores) for pos in names[keys[k]][:per_image]]
        return pd.DataFrame(out, columns=_CELL)

    return run


def best_pairs(csvs: DataFrame, images: DataFrame, per_label: int, per_image: int = 0) -> DataFrame:
    """As match_candidates, with all pairs that are among the best of a label or of an image, and some others.

    Rows of one year and equal names are compared once. Of these each label needs the first ``per_label`` images, each image
    the first ``per_image`` labels.
    """
    left, right = _keyed(csvs, images)
    _, spread = _keyed(csvs, images.repartition("image_pos"))  # few large splits of a small file are read, many tasks make keys
    names = ("year", "station_key", "river_key"), ("year", "title_key")
    copy = lambda pos, keys: F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    # Names are counted once each, as every block of them takes all titles; of titles the rows, which needs no keys.
    of_names = left.select(*names[0]).distinct().groupBy("year").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("csv_blocks"))
    sizes = of_names.join(right.groupBy("year").agg(F.ceil(F.count(F.lit(1)) / (BLOCK * WIDTH)).cast("int").alias("image_blocks")), "year")
    some_labels = left.withColumn("copy", copy("csv_pos", names[0])).filter(F.col("copy") <= max(1, per_image))
    some_titles = spread.withColumn("copy", copy("image_pos", names[1])).filter(F.col("copy") <= per_label)
    dealt = lambda side, keys, pos: F.pmod(F.xxhash64(*keys), F.col(f"{side}_blocks")).cast("int").alias(pos)
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"{side}_blocks") - 1))
    labels = some_labels.join(sizes, "year").select("*", dealt("csv", names[0], "a")).select("*", every("image").alias("b"))
    titles = some_titles.join(sizes, "year").select("*", dealt("image", names[1], "b")).select("*", every("csv").alias("a"))
    # Cells are small tables and much work: as many tasks as there are cells, which adaptive execution doesn't join again.
    cells = sizes.agg(F.sum(F.col("csv_blocks") * F.col("image_blocks"))).first()[0] or 1
    tasks = min(cells, TASKS)
    number = lambda pos: F.coalesce(F.col(pos).cast("long"), F.lit(_NONE)).alias(pos)
    placed = lambda rows, side, pos, *kept: rows.select(*[F.col(c).alias(f"{side}_{c}") for c in ("year", "a", "b")], number(pos), *[F.col(c).alias(c) for c in kept]).repartition(tasks, *[f"{side}_{c}" for c in ("year", "a", "b")]).groupBy(*[f"{side}_{c}" for c in ("year", "a", "b")])
    scored = placed(labels, "of", "csv_pos", "station_key", "river_key").cogroup(placed(titles, "to", "image_pos", "title_key"))
    scored = scored.applyInPandas(_best_of_cell(per_label, per_image), _CELL_TYPES)

    # Back to rows: every label with the first images of a title (way 0), every further image with the first labels of a name (way 1).
    found = {c: F.nullif(F.col(c), F.lit(_NONE)).cast(side.schema[c].dataType) for c, side in (("csv_pos", left), ("image_pos", right))}
    every_label = left.select(F.col("csv_pos").alias("of_csv"), *names[0], F.lit(0).alias("way"))
    pairs = scored.withColumns(found).join(every_label, [*names[0], "way"], "left" if per_image else "inner")
    pairs = pairs.withColumn("csv_pos", F.when(F.col("way") == 0, F.col("of_csv")).otherwise(F.col("csv_pos")))
    if per_image:
        further = right.withColumn("copy", copy("image_pos", names[1])).filter(F.col("copy") > per_label)
        further = further.select(F.col("image_pos").alias("of_image"), *names[1], F.lit(1).alias("way"), F.lit(True).alias("further"))
        pairs = pairs.join(further, [*names[1], "way"], "left").filter("way = 0 OR further")
        pairs = pairs.withColumn("image_pos", F.when(F.col("way") == 0, F.col("image_pos")).otherwise(F.col("of_image")))
    return pairs.select("csv_pos", "image_pos", *SCORES).unionByName(_apart(left, right, per_image > 0))


def resolve_matches(csvs: DataFrame, images: DataFrame, min_score: float = MIN_SCORE, min_csv_margin: float = MIN_CSV_MARGIN, min_image_margin: float = MIN_IMAGE_MARGIN) -> DataFrame:
    """A row per label file: its best image, margins and status confirmed or needs_review. Ties go to the earlier position.

    Without images this is an error.
    """
    if images.isEmpty():
        raise ValueError("No images were found for alignment.")
    ranked = best_pairs(csvs, images, 2, 2)
    of_csv = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "image_pos", *SCORES)))
    first_two = lambda frame, key, other: frame.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), other))).filter("r <= 2")
    best = first_two(ranked, "csv_pos", "image_pos").groupBy("csv_pos").agg(of_csv.alias("b"))
    of_image = first_two(ranked, "image_pos", "csv_pos").groupBy(F.col("image_pos").alias("ip")).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "csv_pos"))).alias("i"))
    rows = best.select("csv_pos", F.get("b", F.lit(0)).alias("x"), F.get("b", F.lit(1))["score"].alias("second")).select("csv_pos", "x.image_pos", *[f"x.{c}" for c in SCORES], "second")
    rows = rows.join(of_image, F.col("image_pos") == F.col("ip"))
    csv_margin, image_margin = F.col("score") - F.coalesce("second", F.lit(0.0)), F.col("score") - F.coalesce(-F.get("i", F.lit(1))["o"], F.lit(0.0))
    confirmed = (F.get("i", F.lit(0))["csv_pos"] == F.col("csv_pos")) & (F.col("score") >= min_score) & (csv_margin >= min_csv_margin) & (image_margin >= min_image_margin)
    return rows.select("csv_pos", "image_pos", *SCORES, F.when(confirmed, "confirmed").otherwise("needs_review").alias("match_status"), F.round(csv_margin, 4).alias("csv_margin"), F.round(image_margin, 4).alias("image_margin"))


def top_candidates(csvs: DataFrame, images: DataFrame, k: int = TOP) -> DataFrame:
    """csv_pos, rank, image_pos, score of the k best images of each label file; k up to TOP."""
    if k > TOP:
        raise ValueError(f"at most {TOP} candidates are kept")
    by_csv = Window.partitionBy("csv_pos").orderBy(F.desc("score"), "image_pos")
    ranked = best_pairs(csvs, images, k).withColumn("rank", F.row_number().over(by_csv))
    return ranked.filter(F.col("rank") <= k).select("csv_pos", "rank", "image_pos", "score")


def match_audit(resolved: DataFrame, images: DataFrame) -> DataFrame:
    """One row of counts."""
    confirmed = resolved.filter("match_status = 'confirmed'")
    counts = resolved.agg(F.count(F.lit(1)).alias("csv_count"), F.count_if(F.col("match_status") == "confirmed").alias("confirmed_count"), F.count_if(F.col("match_status") != "confirmed").alias("needs_review_count"))
    pictures = images.agg(F.count(F.lit(1)).alias("image_count"))
    free = unmatched_images(confirmed, images).agg(F.count(F.lit(1)).alias("unmatched_image_count"))
    return counts.crossJoin(pictures).crossJoin(free)  # one row each


def unmatched_images(resolved: DataFrame, images: DataFrame) -> DataFrame:
    confirmed = resolved.filter("match_status = 'confirmed'").select("image_pos")
    return images.join(confirmed, "image_pos", "left_anti")

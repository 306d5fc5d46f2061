"""Queries of the library's operators, each over whole tables; rows of scalars, every column named."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridmark.functions import grid as G
from gridmark.functions import layout as L
from gridmark.functions import metrics as M
from gridmark.functions import names as N
from gridmark.functions import text as T
from gridmark.operators import align, classify, compare, evaluate, manifest, pages, runs, synth
from gridmark.plans import adapters as A

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _round(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.round(F.col(n), 6) for n in names})


SCORES = ("weighted_score", "character_accuracy", "cell_accuracy", *M.SLICES)


@query
def daily_cells(spark: SparkSession, d: str) -> DataFrame:
    return A.daily_cells(spark, d).select("station", F.col("y").cast("int").alias("y"), F.col("m").cast("int").alias("m"), F.col("d").cast("int").alias("d"), "token")


@query
def grid_csv_text(spark, d):
    return A.grids(spark, d).select("sample_id", G.csv_text("g").alias("csv"))


@query
def grid_latex_text(spark, d):
    return A.grids(spark, d).select("sample_id", G.latex_text("g").alias("latex"))


def _dirty(spark, d):
    """Grids with a row and a column of dots behind them."""
    g = F.transform("g", lambda r: F.concat(r, F.array(F.lit(" "), F.lit("."))))
    blank = F.array(F.array_repeat(F.lit("."), 15), F.array(F.lit("")))
    return A.grids(spark, d).select("sample_id", F.concat(g, blank).alias("g"))


@query
def normalize_targets(spark, d):
    rows = _dirty(spark, d).select("sample_id", G.normalized("g").alias("n"), G.without_blank_rows("g").alias("b"))
    return rows.select("sample_id", G.plain_text("n").alias("csv"), F.size("b").alias("rows_not_blank"))


@query
def header_text(spark, d):
    return A.grids(spark, d).select("sample_id", G.plain_text(F.slice(G.with_header("g", "d|m"), 1, 1)).alias("header"))


@query
def parse_latex(spark, d):
    rows = A.predictions(spark, d).select("sample_id", G.latex_grid("prediction").alias("p"))
    return rows.select("sample_id", F.coalesce(F.size("p"), F.lit(-1)).alias("n_rows"), F.coalesce(G.plain_text("p"), F.lit("none")).alias("csv"))


@query
def parse_target(spark, d):
    rows = G.with_csv_grid(A.predictions(spark, d), "target_csv", "t", strict=True)
    return rows.select("sample_id", F.size("t").alias("n_rows"), G.cell_count("t").cast("long").alias("n_cells"), F.array_join(F.element_at("t", 2), "|").alias("second"))


@query
def pretty_latex(spark, d):
    return A.predictions(spark, d).select("sample_id", F.md5(T.pretty_latex("prediction")).alias("digest"))


@query
def exploded_cells(spark, d):
    cells = G.exploded(_dirty(spark, d), "g", "sample_id")
    return cells.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query
def table_shapes(spark, d):
    return evaluate.table_shapes(A.predictions(spark, d).select(G.latex_grid("prediction").alias("p")).filter("p IS NOT NULL"), "p")


@query
def zero_stats(spark, d):
    blanks = A.grids(spark, d).select(F.size(F.filter(F.flatten("g"), lambda c: c == "")).cast("long").alias("z"))
    return evaluate.nearest_ranks(blanks, "z", 250)


@query
def score_samples(spark, d):
    return _round(evaluate.score_samples(A.predictions(spark, d)).select("sample_id", "error_type", *SCORES), *SCORES)


@query
def score_summary(spark, d):
    return _round(evaluate.summarize(evaluate.score_samples(A.predictions(spark, d))), *SCORES)


@query
def error_histogram(spark, d):
    return evaluate.error_histogram(evaluate.score_samples(A.predictions(spark, d)))


@query
def position_slices(spark, d):
    scored = evaluate.score_samples(A.predictions(spark, d))
    longs = scored.select(F.explode(F.create_map(*[x for s in M.SLICES for x in (F.lit(s), F.col(s))])).alias("slice", "v"))
    return longs.groupBy("slice").agg(F.round(F.avg("v"), 6).alias("score"))


@query
def edit_distances(spark, d):
    """Part names against the next part's name."""
    part = A.table(spark, d, "part").select("p_partkey", "p_name")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    rows = compare.text_accuracy(part.join(after, "p_partkey"), "p_name", "next_name")
    return rows.select("p_partkey", M.edit_distance("p_name", "next_name").cast("int").alias("distance"), F.round("character_accuracy", 6).alias("character_accuracy"))


def _before(spark, d):
    return compare.structure_metrics(A.predictions(spark, d, 17, 3))


def _after(spark, d):
    return compare.structure_metrics(A.predictions(spark, d))


@query
def compare_samples(spark, d):
    return _round(compare.compare_samples(_before(spark, d), _after(spark, d)), "before_cell", "after_cell", "cell_delta")


@query
def run_summary(spark, d):
    return _round(compare.run_summary(_after(spark, d)), "structure_accuracy", "cell_accuracy")


@query
def compare_summary(spark, d):
    return _round(compare.summary_delta(compare.run_summary(_before(spark, d)), compare.run_summary(_after(spark, d))), "structure_accuracy", "cell_accuracy")


@query
def structure_transitions(spark, d):
    return compare.transitions(compare.compare_samples(_before(spark, d), _after(spark, d)))


@query
def id_parity(spark, d):
    r = A.runs(spark, d)
    return compare.id_parity(r.filter("pos % 7 <> 0").select("sample_id"), r.filter("pos % 5 <> 0").select("sample_id"))


@query
def duplicate_ids(spark, d):
    return compare.duplicate_ids(A.runs(spark, d), "user_id")


@query
def classify_outputs(spark, d):
    return classify.classify(_after(spark, d)).select("sample_id", "bucket")


@query
def bucket_counts(spark, d):
    return classify.bucket_counts(classify.classify(_after(spark, d)))


@query
def pick_examples(spark, d):
    score = lambda a, b: evaluate.score_samples(A.predictions(spark, d, a, b)).withColumn("weighted_score", F.round("weighted_score", 6))
    return classify.pick_examples(score(17, 3), score(31, 1))


@query
def delta_histogram(spark, d):
    return classify.delta_histogram(compare.compare_samples(_before(spark, d), _after(spark, d)))


@query
def last_of_each(spark, d):
    """Each user's last event."""
    r = A.runs(spark, d)
    return classify.last_of_each(r, "user_id").select("user_id", "pos", "prediction")


@query
def sample_ids(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", T.sample_id("s_name").alias("sample_id"), T.safe_label("s_name").alias("label"))


@query
def station_meta(spark, d):
    stem = F.concat("station", F.lit("_"), F.col("y").cast("string"), F.lit("_"), "river", F.when(F.col("nk") % 2 == 0, N.CALIBRATED).otherwise("_low"))
    stem = F.regexp_replace(stem, "NATION_", "N")
    return A.grids(spark, d).select("sample_id", *[c.alias(n) for c, n in zip(N.station_parts(stem), ("station", "year", "river"), strict=True)])


@query
def image_meta(spark, d):
    s = A.table(spark, d, "supplier")
    stem = F.concat(F.lit("page_"), F.col("s_suppkey").cast("string"), F.lit("_table2_"), "s_name", F.lit("_x_19"), F.lpad((F.col("s_nationkey")).cast("string"), 2, "0"))
    return s.select("s_suppkey", *[c.alias(n) for c, n in zip(N.image_parts(stem), ("stable_name", "title_text", "year"), strict=True)])


@query
def normalize_names(spark, d):
    name = F.concat(F.lit("page_1_table2"), "s_name", F.element_at(F.array(*[F.lit(x) for x in ("環潭站", "(二)站", "水安陆", "－a,b", "（温水随州）")]), (F.col("s_suppkey") % 5 + 1).cast("int")))
    return A.table(spark, d, "supplier").select("s_suppkey", N.normal_name(name).alias("key"), N.title_key(name).alias("title"))


@query
def match_candidates(spark, d):
    return align.match_candidates(*A.labels_and_titles(spark, d)).filter("score > 0")


@query
def match_resolution(spark, d):
    return align.resolve_matches(*A.labels_and_titles(spark, d))


@query
def top_candidates(spark, d):
    return align.top_candidates(*A.labels_and_titles(spark, d))


@query
def match_audit(spark, d):
    csvs, images = A.labels_and_titles(spark, d)
    return align.match_audit(align.resolve_matches(csvs, images), images)


@query
def unmatched_images(spark, d):
    csvs, images = A.labels_and_titles(spark, d)
    return align.unmatched_images(align.resolve_matches(csvs, images), images).select("image_pos", "title_text")


@query
def match_fuzzy(spark, d):
    """Supplier names as labels against customers' names as titles, year by nation; through the sequence matcher."""
    csvs = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("csv_pos"), F.col("s_name").alias("station_name"), F.lit("").alias("river"), F.col("s_nationkey").cast("string").alias("year"))
    titles = A.table(spark, d, "part").select(F.col("p_partkey").alias("image_pos"), F.concat("p_name", F.lit(" Supplier"), F.col("p_partkey").cast("string")).alias("title_text"), (F.col("p_partkey") % 25).cast("string").alias("year"))
    return align.top_candidates(csvs, titles)


@query
def swift_manifest(spark, d):
    r = manifest.fine_tune_records(A.predictions(spark, d), runs.FORMAT_PROMPT)
    return r.select("sample_id", "query", F.md5("response").alias("response"), F.element_at("images", 1).alias("image"))


@query
def latex_responses(spark, d):
    r = manifest.to_latex_responses(manifest.fine_tune_records(A.predictions(spark, d), "p"))
    return r.select("sample_id", "query", F.md5("response").alias("response"))


@query
def backfill(spark, d):
    m = A.predictions(spark, d).select("sample_id", "target_csv", F.when(F.col("pos") % 2 == 0, "there").alias("target_got_format"))
    return manifest.backfill(m).select("sample_id", F.md5("target_got_format").alias("target"), "updated")


@query
def refresh_targets(spark, d):
    p = A.predictions(spark, d)
    m = p.select("sample_id", F.upper("target_csv").alias("target_csv"))
    return manifest.refresh_targets(p, m, ("target_csv",)).select("sample_id", F.md5("target_csv").alias("target"))


@query
def shard_assign(spark, d):
    return runs.shard_rows(A.runs(spark, d), 4, limit=9001).select("sample_id", "shard_id", "index")


@query
def shard_all(spark, d):
    """Every event's shard; shard_assign has the first 9001, as its SQL does."""
    return runs.shard_rows(A.runs(spark, d), 4).select("sample_id", "shard_id", "index")


@query
def resume_pending(spark, d):
    r = A.runs(spark, d)
    return runs.pending(r, r.filter("pos % 3 = 0")).select("sample_id")


@query
def upsert_runs(spark, d):
    r = A.runs(spark, d).select("pos", "sample_id", "prediction")
    old, new = r.filter("pos % 2 = 0"), r.filter("pos % 3 = 0").select("pos", "sample_id", F.upper("prediction").alias("prediction"))
    return runs.upsert(old, new).select("sample_id", "prediction", F.col("pos").alias("place"))


@query
def merge_shards(spark, d):
    r = A.runs(spark, d).select("pos", "sample_id", "prediction")
    return runs.merge_shards(*[r.filter(f"pos % 3 = {k}") for k in range(2)], r.filter("pos % 3 = 2").drop("prediction"))


@query
def limit_head(spark, d):
    return A.runs(spark, d).orderBy("pos").limit(100).select("pos", "sample_id")


@query
def prompt_build(spark, d):
    c = A.table(spark, d, "conversations")
    t = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    t = t.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("t"))
    return t.select("conv_id", *[F.md5(runs.prompt("t", s, "sys")).alias(s) for s in ("single", "two", "mpt")])


@query
def resolve_query(spark, d):
    c = A.table(spark, d, "conversations").groupBy("role").agg(F.max("conv_id").alias("k"))
    mode = F.when(F.col("role") == "user", "official_format").otherwise("csv")
    return c.select("role", runs.query_text(mode, F.when(F.col("role") == "system", F.lit("own"))).alias("query"))


def _tokens(spark, d):
    """Seven tokens per supplier, placed by arithmetic, some of them labels of statistics."""
    s = A.table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("int").alias("k"))
    k = F.col("k")
    words = F.array(*[F.lit(x) for x in ("平均", "年统计", "日期", "平", "均", "最低", "z")])

    def token(i):
        top = F.pmod(k * 37 + i * 53, F.lit(300)).cast("double")
        left = F.pmod(k * 11 + i * 29, F.lit(150)).cast("double")
        return F.struct(F.get(words, F.pmod(k * (i + 1) + F.floor(k / 7).cast("int") + i * i, F.lit(7))).alias("text"), left.alias("left"), top.alias("top"), (left + 30).alias("right"), (top + 24).alias("bottom"))

    return s.select("s_suppkey", "k", F.transform(F.sequence(F.lit(0), F.pmod(k, F.lit(7))), token).alias("tokens"))


@query
def anchor_select(spark, d):
    a = _tokens(spark, d).select("s_suppkey", L.anchor("tokens").alias("a"))
    return a.select("s_suppkey", "a.text", "a.top", "a.method")


def _profiles(spark, d):
    s = A.table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("int").alias("k"))
    return s.select("s_suppkey", "k", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.pmod(i * i * 7 + F.col("k") * 13, F.lit(130))).alias("dark"), F.lit(200).alias("width"), F.lit(300).alias("height"), F.pmod(F.col("k") * 17, F.lit(320)).cast("double").alias("top"))


@query
def cut_lines(spark, d):
    p = _profiles(spark, d)
    c = L.cut_cascade("dark", "width", "height")
    return p.select("s_suppkey", L.cut_above("dark", "width", "top").cast("int").alias("above"), L.cut_below("dark", "width", "height").cast("int").alias("below"), c["cut"].cast("int").alias("cascade"), c["method"].alias("method"))


@query
def crop_cut(spark, d):
    p = _profiles(spark, d).withColumn("top", F.when(F.col("k") % 3 != 0, F.col("top")))
    cut = L.crop_cut("dark", "width", "height", "top", recognised=False)
    return pages.crop_summary(p.select(cut.alias("cut"))).withColumn("variant", F.lit("off")).unionByName(pages.crop_summary(p.select(L.crop_cut("dark", "width", "height", "top").alias("cut"))).withColumn("variant", F.lit("on")))


@query
def title_merge(spark, d):
    t = _tokens(spark, d).select("s_suppkey", L.recognised_title("tokens", "平").alias("r"))
    return t.select("s_suppkey", "r.merged", "r.title", "r.success", F.size("r.lines").alias("n_lines"))


@query
def title_clean(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", F.concat(F.lit("12"), "p_name", F.lit(" ：流量/表 （x）*_"), "p_brand", F.lit("._")).alias("t"))
    return p.select("p_partkey", N.title_clean("t", F.lit("none"), 20).alias("clean"), N.title_prefix("t", "流量").alias("prefix"), N.stem_clean("t").alias("stem"), T.clip("t", 10).alias("clipped"))


@query
def path_keys(spark, d):
    s = A.table(spark, d, "supplier")
    path = F.concat(F.lit("/pdf/"), F.when(F.col("s_suppkey") % 2 == 0, "流量").otherwise("水位"), F.lit("/"), "s_name")
    key = F.concat(F.lit("19"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit("_"), "s_name")
    return s.select("s_suppkey", N.expected_keyword(path).alias("keyword"), N.year_of_key(key).alias("year"))


@query
def box_clamp(spark, d):
    li = A.table(spark, d, "lineitem")
    box = F.array((F.col("l_partkey") % 300 - 50).cast("double"), (F.col("l_suppkey") % 90).cast("double"), (F.col("l_partkey") % 200 + F.col("l_quantity")).cast("double"), F.col("l_linenumber").cast("double") * 30)
    rows = li.select("l_orderkey", "l_linenumber", L.clamped_box(box, F.lit(180), F.lit(100)).alias("b"))
    return rows.groupBy("b.valid").agg(F.count(F.lit(1)).alias("n"), F.sum("b.x1").alias("x1"), F.sum("b.y1").alias("y1"), F.sum("b.x2").alias("x2"), F.sum("b.y2").alias("y2"))


@query
def reading_order(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", F.struct(F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double")).alias("box"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")).alias("x"))
    boxes = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["n"] != b["n"], a["n"] - b["n"]).otherwise((a["p"] - b["p"]).cast("int"))).alias("x"))
    first = F.get(L.reading_order("x"), 0)
    return boxes.select("l_orderkey", first["n"].alias("line"), F.get(first["box"], 0).alias("left"))


@query
def page_totals(spark, d):
    e = A.table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 11 == 0, "skipped").otherwise("ok")
    p = e.select(F.col("user_id").cast("string").alias("pdf_path"), status.alias("status"), (F.col("event_id") % 4).alias("table_count"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3).alias("title_ocr_success_count"))
    return pages.page_totals(p)


@query
def failure_counts(spark, d):
    e = A.table(spark, d, "events")
    reason = F.element_at(F.array(*[F.lit(x) for x in (*pages.TITLE_REASONS, "other", "invalid_box")]), (F.col("event_id") % 5 + 1).cast("int"))
    return pages.failure_counts(e.select(reason.alias("reason")))


@query
def page_ids(spark, d):
    return pages.page_ids(A.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("count")), "count", "s_suppkey", limit=5)


@query
def skip_existing(spark, d):
    o = A.table(spark, d, "orders")
    return pages.todo(A.table(spark, d, "customer").select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def _pools(spark, d):
    return synth.value_pools(A.grids(spark, d), "g", "name")


@query
def value_pools(spark, d):
    return _pools(spark, d).select(F.col("month").cast("int").alias("month"), F.col("pos").cast("long").alias("pos"), "token")


@query
def spike_pools(spark, d):
    p = _pools(spark, d).withColumn("token", F.when(F.col("month") < 6, F.left("token", F.lit(2))).otherwise(F.left("token", F.lit(1))))
    return synth.spike_pools(p).groupBy(F.col("month").cast("int").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("token").cast("long")).alias("total"))


@query
def split_map(spark, d):
    n = A.table(spark, d, "customer").count()
    return synth.split_map(spark, n, 0.2, 20260408)


@query
def regime_mix(spark, d):
    e = A.table(spark, d, "events").select(synth.regime(100 * synth.hash_uniform(F.lit("s"), "event_id")).alias("data_regime"))
    return synth.regime_mix(e)


@query
def calendar_days(spark, d):
    e = A.table(spark, d, "orders").select(F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"))
    return e.groupBy("m").agg(F.count_if(F.col("d") <= synth.month_days(F.col("m") - 1)).alias("valid"), F.count(F.lit(1)).alias("n"))


TEMPLATE = [["D/M", *[str(m) for m in range(1, 13)]], *[[str(k), *[""] * 12] for k in range(1, 32)]]


@query
def synthetic_tables(spark, d):
    """A seeded table for each supplier, from the pools of all tables; regime, zeros, blanks and text of each."""
    made = synth.generate(spark, A.table(spark, d, "supplier").count(), 7, TEMPLATE, _pools(spark, d))
    flat = F.flatten("grid")
    count = lambda value: F.size(F.filter(flat, lambda c: c == value))
    return made.select("index", "sample_id", "data_regime", count("0").alias("zeros"), count("").alias("blanks"), F.md5(G.csv_text("grid")).alias("digest"))


@query
def layout_cells(spark, d):
    return synth.layout_cells(A.grids(spark, d), "g", "sample_id").groupBy("row_index", "col_index", "cell_type", "x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("n"))


@query
def grid_lines(spark, d):
    s = A.table(spark, d, "supplier").select("s_suppkey", synth.grid_lines((F.col("s_suppkey") % 5).cast("int"), (F.col("s_nationkey") % 4).cast("int"), 60, 35, 50, 70, 25).alias("l"))
    return s.select("s_suppkey", F.inline("l"))


@query
def numeric_tokens(spark, d):
    e = A.table(spark, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in ("1.5", " 2 ", "1e3", "abc", ".5", "5.", "1_000", "1__0", "-inf", "nan", "0x10", "1d", "", "+7", "1e", "１２")]), (F.col("p_partkey") % 16 + 1).cast("int")).alias("t"))
    return e.select("p_partkey", T.is_number("t").alias("ok"))


@query
def decode_text(spark, d):
    """The encodings of supplier names written in one or the other."""
    from gridmark.sources.files import decode_text as decode

    s = A.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.encode(F.concat("s_name", F.lit("流量\r\n1\r2")), "UTF-8")).otherwise(F.unhex(F.lit("C1F7C1BF0D0A31"))).alias("content"))
    return s.withColumn("t", decode("content")).select("s_suppkey", "t.text", "t.encoding")


@query
def csv_edge_cases(spark, d):
    forms = ["a,b\n\nc", 'x,"y,z"\n', '"q""r",s', "", ",", "a\r\nb\rc", '"x\ny"']
    s = A.table(spark, d, "supplier").select("s_suppkey", F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("s_suppkey") % len(forms) + 1).cast("int")).alias("t"))
    return G.with_csv_grid(s, "t", "g").select("s_suppkey", F.size("g").cast("int").alias("n_rows"), F.array_join(F.transform("g", lambda r: F.array_join(r, "|")), "/").alias("cells"))

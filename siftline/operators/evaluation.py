"""Evaluation of training pools by light models: centroids, remembered tags, retrieved summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.functions.text import words_of
from siftline.functions.vectors import cosine
from siftline.operators.selection import LABELLED_TASKS


def training_records(selected: DataFrame, split: str = "synthetic") -> DataFrame:
    """Selected candidates as training records: their id, the given split, and tokens, tags and summary from the metadata, or from its raw item.

    ``metadata`` is JSON; the record's own has synthetic and the scores, where the candidate's don't say otherwise. Null texts count as empty.
    """
    get = lambda n: F.coalesce(F.get_json_object("metadata", f"$.{n}"), F.get_json_object("metadata", f"$.raw_item.{n}"))
    listed = lambda n: F.from_json(get(n), "array<string>")
    own = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    base = F.map_from_arrays(F.array(F.lit("synthetic"), F.lit("scores")), F.array(F.lit("true"), F.col("scores") if "scores" in selected.columns else F.lit("{}")))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
    return selected.select(F.col("candidate_id").alias("id"), "dataset_id", "task", "language", F.lit(split).alias("split"), F.coalesce("text", F.lit("")).alias("text"), "label", listed("tokens").alias("tokens"), listed("tags").alias("tags"), get("summary").alias("summary"), merged.alias("metadata"))


def _scores(pairs: DataFrame, cell: list[str]) -> DataFrame:
    """``cell, macro_f1, accuracy, ece`` of pairs of ``truth`` and ``guess`` with their confidence ``p``."""
    n = pairs.groupBy(*cell, "truth", "guess").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(F.lit(0))
    sides = n.select(*cell, F.explode(F.array(F.struct(F.col("truth").alias("label"), hit.alias("hit"), F.col("n").alias("seen")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("hit"), F.col("n").alias("seen")))).alias("x")).select(*cell, "x.*")
    f1 = sides.groupBy(*cell, "label").agg((2 * F.sum("hit") / F.sum("seen")).alias("f1"), F.sum("hit").alias("hit"), F.sum("seen").alias("seen"))
    f1 = f1.groupBy(*cell).agg(F.avg("f1").alias("macro_f1"), (2 * F.sum("hit") / F.sum("seen")).alias("accuracy"))
    bins = pairs.groupBy(*cell, F.least(F.lit(9), F.floor(F.col("p") * 10)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("truth") == F.col("guess")).cast("double")).alias("a"), F.avg("p").alias("c"))
    return f1.join(bins.groupBy(*cell).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece")), cell)


def centroid_scores(train: DataFrame, test: DataFrame, cell: list[str], vector: str = "vector") -> DataFrame:
    """``cell, macro_f1, accuracy, ece``: every test row gets the label whose mean training vector of its cell is most alike.

    Confidence is the softmax of the cosines at temperature 1; ties, to 9 digits, go to the first label. Null labels train nothing and read "None" in the
    test. A cell's means, one a label, are joined to its test rows. Cells without training labels or test rows are left out.
    """
    mean = train.filter(F.col("label").isNotNull()).select(*cell, "label", F.posexplode(vector).alias("_i", "_v")).groupBy(*cell, "label", "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    centre = mean.groupBy(*cell, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("_c"))
    known = centre.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("label", "_c"))).alias("_known"))
    x = test.withColumn("_v", F.transform(vector, lambda v: v.cast("double"))).join(known, cell)
    x = x.withColumn("_cos", F.transform("_known", lambda k: F.struct((-F.round(cosine(F.col("_v"), k["_c"]), 9)).alias("first"), k["label"].alias("label"), cosine(F.col("_v"), k["_c"]).alias("cos"))))
    top = F.array_min("_cos")
    p = 1 / F.aggregate("_cos", F.lit(0.0), lambda s, k: s + F.exp(k["cos"] - top["cos"]))
    return _scores(x.select(*cell, F.coalesce("label", F.lit("None")).alias("truth"), top["label"].alias("guess"), p.alias("p")), cell)


def remembered_tags(train: DataFrame, test: DataFrame, cell: list[str]) -> DataFrame:
    """``cell, entity_micro_f1``: every test token gets the most frequent tag of its lower-case form in the cell's training data, "O" if unseen.

    ``train`` and ``test`` have id, tokens and tags; texts are their words where there are no tokens, and tokens beyond
    the tags are left out. Equally frequent tags go by the first id and place at which they were seen.
    """
    words = lambda d: d.withColumn("_t", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(words_of(F.col("text"))))
    pair = lambda tags: F.posexplode(F.slice(F.arrays_zip(F.col("_t").alias("t"), tags.alias("g")), F.lit(1), F.least(F.size("_t"), F.size(tags)))).alias("_i", "_x")
    seen = words(train).filter(F.size("tags") > 0).select(*cell, "id", pair(F.col("tags"))).select(*cell, F.lower("_x.t").alias("_w"), F.col("_x.g").alias("_g"), F.struct("id", "_i").alias("_at"))
    n = seen.groupBy(*cell, "_w", "_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_at"))
    best = n.groupBy(*cell, "_w").agg(F.min_by("_g", F.struct(-F.col("_n"), "_at")).alias("_p"))
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.transform("_t", lambda _: F.lit("O")))
    asked = words(test).withColumn("_tags", tags).select(*cell, pair(F.col("_tags"))).select(*cell, F.lower("_x.t").alias("_w"), F.col("_x.g").alias("_g"))
    both = asked.join(best, [*cell, "_w"], "left").withColumn("_p", F.coalesce("_p", F.lit("O")))
    g, p = F.col("_g"), F.col("_p")
    n = both.groupBy(*cell).agg(F.count_if((g == p) & (g != "O")).alias("tp"), F.count_if((g != p) & (p != "O")).alias("fp"), F.count_if((g != p) & (g != "O")).alias("fn"))
    return n.select(*cell, F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)).alias("entity_micro_f1"))


def retrieved_summaries(train: DataFrame, test: DataFrame, cell: list[str], vector: str = "vector") -> DataFrame:
    """``cell, summary_jaccard``: the mean overlap of a test row's summary with that of the most similar training row of its cell.

    Training pools are curated: a cell's rows are joined to its test rows, and the best is taken before anything else is shuffled.
    Equal cosines, to 9 digits, go by id. Null summaries count as empty; two empty ones overlap by 0.
    """
    t = train.select(*cell, F.col("id").alias("_id"), F.col(vector).alias("_tv"), F.array_distinct(words_of(F.col("summary"))).alias("_ts"))
    near = test.select(*cell, "id", F.col(vector).alias("_v"), F.array_distinct(words_of(F.col("summary"))).alias("_s")).join(t, cell)
    best = near.groupBy(*cell, "id").agg(F.min_by(F.struct("_s", "_ts"), F.struct(-F.round(cosine(F.col("_v"), F.col("_tv")), 9), "_id")).alias("x"))
    score = F.size(F.array_intersect("x._s", "x._ts")) / F.greatest(F.lit(1), F.size(F.array_union("x._s", "x._ts")))
    return best.groupBy(*cell).agg(F.avg(score).alias("summary_jaccard"))


def evaluate(gold: DataFrame, synthetic: DataFrame | None, test: DataFrame, embed: Callable[[Column], Column], name: str, cell: list[str] | None = None) -> DataFrame:
    """One row per cell with test rows: the sizes of its training and test sets, the evaluator and a map of metrics, by the cell's task.

    Records have id, task, the cell's columns, text, label, and for their tasks tokens, tags and summary. Labelled tasks are scored by centroids, tagging
    by remembered tags, summarization by retrieval; other tasks raise ValueError, as does the union of unlike sets elsewhere. Texts are embedded once.
    """
    cell = cell or ["dataset_id", "task", "language"]
    kinds = {"id": "string", "text": "string", "label": "string", "tokens": "array<string>", "tags": "array<string>", "summary": "string"}
    shape = lambda d: d.select(*cell, *[(F.col(c) if c in d.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    g, s, t = shape(gold), shape(synthetic) if synthetic is not None else shape(gold).filter("false"), shape(test)
    unknown = t.select("task").distinct().filter(~F.col("task").isin(*LABELLED_TASKS, "named_entity_recognition", "summarization")).limit(1).collect()
    if unknown:
        raise ValueError(f"unsupported task {unknown[0][0]}")
    train = g.unionByName(s)
    size = lambda d, n: d.groupBy(*cell).agg(F.count(F.lit(1)).alias(n))
    sizes = size(t, "test_size").join(size(g, "train_gold"), cell, "left").join(size(s, "train_synthetic"), cell, "left").na.fill(0, ["train_gold", "train_synthetic"])
    vector = lambda d: d.withColumn("vector", embed(F.coalesce("text", F.lit(""))))
    of = lambda d, *tasks: d.filter(F.col("task").isin(*tasks))
    scores = centroid_scores(vector(of(train, *LABELLED_TASKS)), vector(of(t, *LABELLED_TASKS)), cell)
    tags = remembered_tags(of(train, "named_entity_recognition"), of(t, "named_entity_recognition"), cell)
    summaries = retrieved_summaries(vector(of(train, "summarization")), vector(of(t, "summarization")), cell)
    every = sizes.join(scores, cell, "left").join(tags, cell, "left").join(summaries, cell, "left")
    names = ["macro_f1", "accuracy", "ece", "entity_micro_f1", "summary_jaccard"]
    metrics = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)), lambda _, v: v.isNotNull())
    return every.select(*cell, "train_gold", "train_synthetic", "test_size", F.lit(f"lightweight_{name}").alias("evaluator"), metrics.alias("metrics"))


def tag_counts(df: DataFrame, cell: list[str], tags: str) -> DataFrame:
    """``cell, rows, tokens, labels``: sentences with a tag, their tags, and how many there are of each but "O"."""
    n = df.filter(F.size(tags) > 0).select(*cell, F.monotonically_increasing_id().alias("_i"), F.explode(tags).alias("_t")).groupBy(*cell, "_t").agg(F.count(F.lit(1)).alias("n"))
    rows = df.filter(F.size(tags) > 0).groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"))
    per = n.groupBy(*cell).agg(F.sum("n").alias("tokens"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_t") != "O", F.struct("_t", "n"))))).alias("labels"))
    return rows.join(per, cell)


def manifest_of(df: DataFrame, label: str | None = "label", path: Column | None = None) -> DataFrame:
    """A manifest of records: ``dataset_id, task, language, split, path, n_rows, labels`` with the sorted counts of labels; without a label column none are counted."""
    cell = ["dataset_id", "task", "language", "split"]
    where = path if path is not None else F.concat_ws("/", F.lit("data"), "dataset_id", "language", "split")
    if label is None:
        return df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_rows")).select(*cell, where.alias("path"), "n_rows", F.create_map().cast("map<string,bigint>").alias("labels"))
    n = df.groupBy(*cell, F.coalesce(F.col(label), F.lit("None")).alias("_l")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*cell).agg(F.sum("n").alias("n_rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_l", "n")))).alias("labels")).select(*cell, where.alias("path"), "n_rows", "labels")


def rehydrated(gold: DataFrame, source: DataFrame, cell: list[str]) -> DataFrame:
    """Gold with withheld texts filled in from ``source``: a left join by cell and the last part of the id, checked by digest.

    ``source`` has the cell's columns, ``index`` and ``text``. A row is "restored" where its digest agrees or it has none, "mismatch" where not, "missing" without a source;
    only restored ones get the text. ``writable`` tells of each cell whether none of its rows mismatched, as only such a cell may be overwritten.
    """
    s = source.select(*cell, F.col("index").cast("string").alias("_i"), F.col("text").alias("_t"))
    j = gold.withColumn("_i", F.element_at(F.split("id", ":"), -1)).join(s, [*cell, "_i"], "left")
    digest = F.substring(F.sha2(F.col("_t").cast("binary"), 256), 1, 16)
    state = F.when(F.col("_t").isNull(), "missing").when(F.col("text_sha256").isNull() | (digest == F.col("text_sha256")), "restored").otherwise("mismatch")
    j = j.withColumn("state", state).withColumn("text", F.when(F.col("state") == "restored", F.col("_t")).otherwise(F.col("text")))
    return j.withColumn("writable", F.count_if(F.col("state") == "mismatch").over(Window.partitionBy(*cell)) == 0).drop("_i", "_t")

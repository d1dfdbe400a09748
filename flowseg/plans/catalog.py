"""Queries over the test tables, one or more per operator."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseg.functions.columns import as_double_array, chebyshev, hash_below, row_hash
from flowseg.functions.tables import discard, materialize, scratch_path, shuffles_cleared
from flowseg.operators import classify, clean, cluster, enrich, evaluate, features, reduce, rules, sample
from flowseg.plans import jobs
from flowseg.plans.flows import FIVE_TUPLE, SPEC, flows, table
from flowseg.sources import files, load, save, stage
from flowseg.specs import SEED, SPECS, FlowSpec

SCALED = ["duration", "orig_bytes", "orig_pkts", "orig_ip_bytes"]
ENCODED = ["proto", "service", "conn_state"]
LARGE_ENCODED = ["uid", "src_ip", "dst_ip", "proto"]
SAMPLE_ROWS = 100
LARGE_SAMPLE_ROWS = 20_000


def _rounded(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


def _spread_vector(df: DataFrame, vector: str, names: list[str], keep: list[str], digits: int = 4) -> DataFrame:
    """One rounded column per vector component."""
    arr = vector_to_array(F.col(vector))
    return df.select(*keep, *[F.round(arr[i], digits).alias(c) for i, c in enumerate(names)])


def _metrics_rounded(df: DataFrame) -> DataFrame:
    return _rounded(df, ["accuracy", "sensitivity", "specificity", "precision", "f1"], 6)


# --- scans and sinks ------------------------------------------------------


def _zeek_fields() -> list[str]:
    """The 23 fields of a log line in terms of the flows view, missing values as a dash."""
    source = {
        "ts": "duration", "uid": "uid", "id_orig_h": "src_ip", "id_orig_p": "src_port", "id_resp_h": "dst_ip",
        "id_resp_p": "dst_port", "proto": "proto", "service": "translate(service, ' ', '_')",
        "duration": "duration", "orig_bytes": "orig_bytes", "resp_bytes": "resp_bytes", "conn_state": "conn_state",
        "orig_pkts": "orig_pkts", "orig_ip_bytes": "orig_ip_bytes",
    }
    fields = [source.get(name) for name in SPECS["iot23"].schema.names[:-2]]
    return [f"coalesce(CAST({c} AS STRING), '-')" if c else "'-'" for c in fields] + [
        "CASE WHEN label = 1 THEN 'Malicious' ELSE 'Benign' END",
        "CASE WHEN label = 1 THEN detailed_label ELSE '-' END",
    ]


def zeek_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows as log lines: tabs or blanks, some comments, some lines cut short."""
    fields = _zeek_fields()
    tabs, blanks = f"concat_ws('\t', {', '.join(fields)})", f"concat_ws('   ', {', '.join(fields)})"
    short = f"concat_ws(' ', {', '.join(fields[:9])})"
    return flows(spark, sf_dir).select(
        F.expr(
            f"CASE WHEN src_port = 40001 AND orig_pkts = 1 THEN concat('#', {tabs})"
            f" WHEN src_port = 40002 AND orig_pkts = 2 THEN {short}"
            f" WHEN orig_pkts % 2 = 0 THEN {blanks} ELSE {tabs} END"
        ).alias("value")
    )


def zeek_parse(spark, sf_dir):
    good, _ = files.parse_zeek(materialize(zeek_lines(spark, sf_dir)), SPECS["iot23"])
    return _rounded(good, ["ts", "duration"], 6)


def zeek_rejects(spark, sf_dir):
    _, bad = files.parse_zeek(materialize(zeek_lines(spark, sf_dir)), SPECS["iot23"])
    return bad.groupBy("n_fields").agg(F.count(F.lit(1)).alias("n_lines"))


#: Of files that nothing reads.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def zeek_scan(spark, sf_dir):
    """Log files in nested folders, beside files that must not be read."""
    root, once = scratch_path(spark, "zeek"), scratch_path(spark, "lines")
    with shuffles_cleared(spark):
        zeek_lines(spark, sf_dir).write.option("compression", "zstd").parquet(once)  # three writes read them
        lines = spark.read.schema("value string").parquet(once)
        tabbed = F.col("value").contains("\t")
        lines.filter(tabbed).write.text(f"{root}/capture-1/logs")
        lines.filter(~tabbed).write.text(f"{root}/capture-2/logs/older")
        lines.write.options(**PACKED).csv(f"{root}/capture-1/other")
    discard(spark, once)
    parsed = files.read_zeek_conn(spark, replace(SPECS["iot23"], path=root, file_glob="*.txt"))
    return parsed.groupBy("proto", "label").agg(
        F.count(F.lit(1)).alias("n_flows"), F.sum("orig_bytes").alias("orig_bytes"), F.count("service").alias("n_service")
    )


CSV_COLUMNS = ["src_ip", "src_port", "dst_ip", "dst_port", "service", "duration", "resp_bytes", "label"]


def _csv_spec(schema: T.StructType, path: str, header: bool) -> FlowSpec:
    return FlowSpec(
        name="csv", path=path, kind="csv", file_glob="*.csv", schema=schema, uid="uid", header=header,
        generated_uid=True, noisy=(), labels=("label",), five_tuple=FIVE_TUPLE,
    )


def _csv_round_trip(spark, sf_dir, header: bool) -> DataFrame:
    root = scratch_path(spark, "csv")
    source = flows(spark, sf_dir).select(*CSV_COLUMNS)
    named = source.toDF(*[f"h{i}" for i in range(len(CSV_COLUMNS))]) if header else source
    named.write.option("nullValue", "-").option("header", header).csv(root)
    return files.read_csv_flows(spark, _csv_spec(source.schema, root, header))


def csv_scan(spark, sf_dir):
    return _rounded(_csv_round_trip(spark, sf_dir, header=False).drop("uid"), ["duration"], 6)


def csv_header_scan(spark, sf_dir):
    """Header names are ignored in favour of the schema; the generated ids are unique."""
    return _csv_round_trip(spark, sf_dir, header=True).groupBy("service").agg(
        F.count(F.lit(1)).alias("n_flows"),
        F.countDistinct("uid").alias("n_uids"),
        F.sum("resp_bytes").alias("resp_bytes"),
    )


def _damaged_csv(spark, sf_dir) -> FlowSpec:
    """The flows as records: some cut short, some with a field too many, some with a value that is no number."""
    root = scratch_path(spark, "csv")
    source = flows(spark, sf_dir).select(*CSV_COLUMNS, "orig_pkts")
    fields = [f"coalesce(CAST({c} AS STRING), '-')" for c in CSV_COLUMNS]
    odd = [f"CASE WHEN {CSV_ODD_VALUE} THEN 'n/a' ELSE {x} END" if c == "resp_bytes" else x for c, x in zip(CSV_COLUMNS, fields)]
    record = (
        f"CASE WHEN {CSV_SHORT} THEN concat_ws(',', {', '.join(fields[:5])})"
        f" WHEN {CSV_LONG} THEN concat_ws(',', {', '.join(fields)}, 'more') ELSE concat_ws(',', {', '.join(odd)}) END"
    )
    source.select(F.expr(record).alias("value")).write.text(root)
    return replace(_csv_spec(source.drop("orig_pkts").schema, root, False), file_glob="*.txt")


CSV_SHORT = "src_port = 40002 AND orig_pkts % 10 = 2"
CSV_LONG = "src_port = 40003 AND orig_pkts % 10 = 3"
CSV_ODD_VALUE = "src_port = 40004 AND orig_pkts % 10 = 4"


def csv_parse(spark, sf_dir):
    """Records of the right width; a value that does not parse is NULL."""
    good, _ = files.parse_csv_flows(spark, _damaged_csv(spark, sf_dir))
    return _rounded(good.drop("uid"), ["duration"], 6)


def csv_rejects(spark, sf_dir):
    """Records of another width, as they stood in the file."""
    _, bad = files.parse_csv_flows(spark, _damaged_csv(spark, sf_dir))
    first = F.split("value", ",")[0].alias("src_ip")
    return bad.groupBy("n_fields", first).agg(F.count(F.lit(1)).alias("n_records"))


def stage_reuse(spark, sf_dir):
    """The second call reads the stored stage; its own builder would drop all rows."""
    path = scratch_path(spark, "stage")
    source = flows(spark, sf_dir).select("uid", "proto", "orig_bytes")
    stage(spark, path, lambda: source)
    return stage(spark, path, lambda: source.filter("false"))


def stage_rebuilt(spark, sf_dir):
    """Other settings build the stage anew, the same ones again don't."""
    path = scratch_path(spark, "stage")
    source = flows(spark, sf_dir).select("uid", "proto", "orig_bytes")
    stage(spark, path, lambda: source.filter("false"), "large flows: none")
    stage(spark, path, lambda: source.filter("orig_bytes > 30000"), "large flows: 30000")
    return stage(spark, path, lambda: source, "large flows: 30000")


def save_and_load(spark, sf_dir):
    """Overwriting a stage replaces it."""
    path = scratch_path(spark, "save")
    source = flows(spark, sf_dir).select("uid", "detailed_label", "orig_pkts")
    save(source.filter("orig_pkts > 25"), path)
    save(source, path)
    return load(spark, path)


def rules_csv(spark, sf_dir):
    path = scratch_path(spark, "rules")
    found = rules.rule_table(flows(spark, sf_dir), FIVE_TUPLE, "clusterId")
    rules.write_rules(found, path)
    return spark.read.schema(found.schema).option("header", True).csv(path)


def feature_names(spark, sf_dir):
    """Stored names of the vector components, with the number of flows behind each."""
    path = scratch_path(spark, "names")
    table_ = flows(spark, sf_dir)
    names = features.numeric_columns(table_, SPEC.protected) + features.string_columns(table_, SPEC.protected)
    features.save_feature_names(spark, names, path)
    counts = table_.agg(*[F.count(c).alias(c) for c in names])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_known")) for c in names])).alias("x"))
    return spark.read.schema("pos int, name string").json(path).join(F.broadcast(long.select("x.*")), "name")


# --- expressions ----------------------------------------------------------


def binary_label(spark, sf_dir):
    return clean.binary_label(flows(spark, sf_dir).select("uid", "detailed_label"), "detailed_label", "DDoS", "is_ddos")


def add_uid(spark, sf_dir):
    """Rows that are not unique: the id counts the copies."""
    return clean.add_uid(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), scan=True)


def add_uid_salted(spark, sf_dir):
    """Few distinct rows with very many copies each."""
    return clean.add_uid(flows(spark, sf_dir).select("proto", "conn_state"))


# --- features -------------------------------------------------------------


def label_encode(spark, sf_dir):
    df = flows(spark, sf_dir).select("uid", *ENCODED)
    return features.label_encode(df, ENCODED).drop(*ENCODED)


def label_encode_large(spark, sf_dir):
    """Columns with more labels than are broadcast, one of them different in every row."""
    df = materialize(flows(spark, sf_dir).select(*LARGE_ENCODED, F.monotonically_increasing_id().alias("row")))
    return features.label_encode(df, LARGE_ENCODED, rows=50, position="row").drop("src_ip", "dst_ip", "proto", "row")


def impute_mean(spark, sf_dir):
    df = flows(spark, sf_dir).select("uid", "resp_bytes", (F.col("resp_bytes") / 8.0).alias("resp_words"))
    return _rounded(features.impute_mean(df, ["resp_bytes", "resp_words"]), ["resp_words"], 3)


def standardize(spark, sf_dir):
    df = features.assemble(flows(spark, sf_dir).select("uid", *SCALED), SCALED)
    return _spread_vector(features.standardize(df), "scaled_features", SCALED, ["uid"])


def _correlations(spark, sf_dir) -> DataFrame:
    df = features.assemble(flows(spark, sf_dir).select(*SCALED), SCALED, "scaled_features")
    return features.correlation_matrix(df, SCALED)


def corr_matrix(spark, sf_dir):
    return _rounded(_correlations(spark, sf_dir).drop("i", "j"), ["r"], 6)


def corr_pairs(spark, sf_dir):
    return _rounded(features.correlated_pairs(_correlations(spark, sf_dir)), ["abs_r"], 6)


def prune_correlated(spark, sf_dir):
    """The table without its redundant columns."""
    df = flows(spark, sf_dir).select("uid", *SCALED)
    return features.prune_correlated(df, _correlations(spark, sf_dir), SCALED)[0]


def preprocess(spark, sf_dir):
    """Encode, impute, scale: all vector components of every flow."""
    done = jobs.preprocess(flows(spark, sf_dir), SPEC)
    return _spread_vector(done.table, "scaled_features", [f"s_{c}" for c in done.names], ["uid"])


def preprocess_pruned(spark, sf_dir):
    """The same without the redundant features."""
    done = jobs.preprocess(flows(spark, sf_dir), SPEC, prune_vector=True)
    return _spread_vector(done.table, "scaled_features", [f"s_{c}" for c in done.names], ["uid"])


# --- components -----------------------------------------------------------


def _embedding_vectors(spark, sf_dir) -> DataFrame:
    width = 64
    df = table(spark, sf_dir, "embeddings")
    parts = [F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(width)]
    return features.assemble(df.select("vec_id", *parts), [f"x{i}" for i in range(width)], "scaled_features")


def pca_norms(spark, sf_dir):
    """All components together keep every vector's length."""
    df = _embedding_vectors(spark, sf_dir)
    full = reduce.pca_project(df, reduce.vector_size(df, "scaled_features"))
    squares = F.aggregate(vector_to_array("pca_features"), F.lit(0.0), lambda s, x: s + x * x)
    return full.select("vec_id", F.round(squares, 6).alias("squared_norm"))


def pca_total_variance(spark, sf_dir):
    """The components carry the variance of the inputs."""
    df = _embedding_vectors(spark, sf_dir)
    k = reduce.vector_size(df, "scaled_features")
    arr = vector_to_array(F.col("pca_features"))
    total = reduce.pca_project(df, k).select(*[arr[i].alias(f"p{i}") for i in range(k)])
    spread = sum((F.var_samp(f"p{i}") for i in range(1, k)), F.var_samp("p0"))
    return total.agg(F.round(spread, 6).alias("total_variance"))


PLANE = ["orig_pkts", "duration"]


def _plane_shares(spark, sf_dir) -> tuple[DataFrame, list[float]]:
    df = features.assemble(flows(spark, sf_dir).select(*PLANE), PLANE, "scaled_features")
    return df, reduce.explained_variance(df)


def pca_explained_variance(spark, sf_dir):
    """Two inputs: the shares have a closed form."""
    return _rounded(reduce.shares_table(*_plane_shares(spark, sf_dir)), ["share", "cumulative"], 6)


def pca_choose_k(spark, sf_dir):
    df, shares = _plane_shares(spark, sf_dir)
    targets = [(t, reduce.choose_k(shares, t)) for t in (0.5, 0.99, 2.0)]
    return df.sparkSession.createDataFrame(targets, "target double, k int")


def pca_plane(spark, sf_dir):
    """One component of two, turned so that it grows with the first input."""
    df = features.assemble(flows(spark, sf_dir).select("uid", *PLANE), PLANE, "scaled_features")
    first = vector_to_array("pca_features")[0].alias("first")
    reduced = materialize(jobs.reduce_table(df, replace(SPEC, pca_k=1)).select("uid", PLANE[0], first))
    sign = -1.0 if reduced.agg(F.covar_samp("first", PLANE[0])).first()[0] < 0 else 1.0
    return reduced.select("uid", F.round(F.col("first") * sign, 4).alias("first"))


def pca_reduce(spark, sf_dir):
    """The number of components chosen on a sample, then fitted on and applied to all flows."""
    done = jobs.preprocess(flows(spark, sf_dir), SPEC)
    out = jobs.reduce_table(done.table.select("uid", "scaled_features"), SPEC)
    arr = vector_to_array(F.col("pca_features"))
    return out.select("uid", F.size(arr).alias("k"), F.round(arr[0], 6).alias("first"))


# --- samples and weights --------------------------------------------------


def hash_sample(spark, sf_dir):
    return sample.fraction_sample(flows(spark, sf_dir).select("uid", "proto"), "uid", 0.2)


def capped_sample(spark, sf_dir):
    return sample.capped_sample(flows(spark, sf_dir).select("uid", "proto"), "uid", SAMPLE_ROWS)


def balanced_sample(spark, sf_dir):
    return sample.balanced_sample(flows(spark, sf_dir).select("uid", "label"), "uid", "label", SAMPLE_ROWS)


def balanced_sample_large(spark, sf_dir):
    """More rows of a class than a task may rank."""
    return sample.balanced_sample(flows(spark, sf_dir), "uid", "label", LARGE_SAMPLE_ROWS, window_rows=1_000).select("uid", "label")


def hash_split(spark, sf_dir):
    train, test = sample.train_test_split(flows(spark, sf_dir).select("uid"), "uid")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def undersample(spark, sf_dir):
    """Benign flows are the larger class here."""
    df = flows(spark, sf_dir).select("uid", "label")
    return sample.undersample_majority(df, "uid", "label", majority=0, minority=1)


def class_weights(spark, sf_dir):
    return _rounded(sample.class_weights(flows(spark, sf_dir), "label"), ["weight"], 6)


def weighted_rows(spark, sf_dir):
    return _rounded(sample.with_class_weight(flows(spark, sf_dir).select("uid", "label"), "label"), ["class_weight"], 6)


# --- clusters -------------------------------------------------------------


def _clustered_part(df: DataFrame, fraction: float) -> DataFrame:
    return df.filter(hash_below(row_hash(SEED, "uid"), fraction)).select("uid", "clusterId")


def attach_clusters(spark, sf_dir):
    df = flows(spark, sf_dir)
    return cluster.attach_clusters(
        sample.fraction_sample(df.select("uid", "proto"), "uid", 0.05), _clustered_part(df, 0.02), "uid"
    )


def flows_in_clusters(spark, sf_dir):
    df = flows(spark, sf_dir)
    return cluster.flows_in_clusters(df.drop("clusterId").select("uid", "src_ip", "label"), _clustered_part(df, 0.05), "uid", "clusterId")


def largest_clusters(spark, sf_dir):
    return cluster.largest_clusters(flows(spark, sf_dir).filter("orig_pkts > 10"), 4, "clusterId")


def largest_clusters_all(spark, sf_dir):
    """The ten largest of many segments, over all flows."""
    segment = F.when(F.col("dst_port") % 23 == 0, cluster.NOISE).otherwise(F.col("dst_port") % 23).alias("segment")
    return cluster.largest_clusters(flows(spark, sf_dir).select(segment), cluster="segment")


def cluster_summary(spark, sf_dir):
    return cluster.summary(flows(spark, sf_dir), "clusterId")


def chebyshev_from_first(spark, sf_dir):
    """Distance of every vector from its label's first one."""
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.select("vec_id", "label", as_double_array(vectors, "embedding").alias("x"))
    first = vectors.groupBy("label").agg(F.min_by("x", "vec_id").alias("first"))
    return vectors.join(first, "label").select("vec_id", F.round(chebyshev(F.col("x"), F.col("first")), 6).alias("distance"))


def core_distance(spark, sf_dir):
    return _rounded(cluster.core_distance(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), ["core_distance"], 6)


def reachability(spark, sf_dir):
    return _rounded(cluster.reachability(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), ["reachability"], 6)


def optics_segments(spark, sf_dir):
    return cluster.optics_segments(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def optics_by_group(spark, sf_dir):
    return cluster.optics_segments(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])


#: Small enough for the test tables to take every way that large ones take.
SMALL = {"block": 128, "task_rows": 200}


def core_distance_blocks(spark, sf_dir):
    """The same with vectors that search beyond their block."""
    found = cluster.core_distance(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", block=SMALL["block"])
    return _rounded(found, ["core_distance"], 6)


def reachability_blocks(spark, sf_dir):
    """The same from a tree grown in rounds and a plot put together from parts."""
    found = cluster.reachability(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", **SMALL)
    return _rounded(found, ["reachability"], 6)


def optics_segments_blocks(spark, sf_dir):
    """The same with a plot that is scanned in blocks."""
    return cluster.optics_segments(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", plot_block=150, **SMALL)


def flow_segments(spark, sf_dir):
    """A balanced sample of the flows, reduced and clustered."""
    done = jobs.preprocess(flows(spark, sf_dir), SPEC)
    reduced = materialize(jobs.reduce_table(done.table.select("uid", "label", "scaled_features"), SPEC))
    return jobs.cluster_table(reduced, SPEC)


# --- trees ----------------------------------------------------------------


#: Neither features nor read by the profile.
NOT_FOR_TREE = ["prediction", "clusterId", "detailed_label", "src_port"]


def _trained(spark, sf_dir, strategy: str, enriched: bool = False) -> DataFrame:
    done = jobs.preprocess(flows(spark, sf_dir).drop(*NOT_FOR_TREE), SPEC)
    base = done.table
    if enriched:
        base = jobs.enrich_table(done.plain, SPEC, ["uid", "label", *done.names], done.scale)
    _, tested = jobs.train(base, SPEC, strategy, enriched)
    return tested.select("uid", "label", "prediction")


def tree_plain(spark, sf_dir):
    return _trained(spark, sf_dir, "plain")


def tree_undersampled(spark, sf_dir):
    return _trained(spark, sf_dir, "undersample")


def tree_weighted(spark, sf_dir):
    return _trained(spark, sf_dir, "weighted")


def tree_enriched(spark, sf_dir):
    return _trained(spark, sf_dir, "plain", enriched=True)


def tree_enriched_undersampled(spark, sf_dir):
    return _trained(spark, sf_dir, "undersample", enriched=True)


def tree_enriched_weighted(spark, sf_dir):
    return _trained(spark, sf_dir, "weighted", enriched=True)


#: Noisy labels over few different vectors: a tree's answer is the (weighted) majority of the rows with the vector,
#: so the strategies and the enrichment give different predictions.
VOTES = {"third": "CAST(floor((orig_pkts - 1) / 17) AS INT)", "label": "CASE WHEN orig_bytes % 100 < 40 + orig_pkts THEN 1 ELSE 0 END"}
VOTES_SPEC = replace(SPEC, five_tuple=FIVE_TUPLE | {"SIP": "src_port"})


def _votes_flows(spark, sf_dir) -> DataFrame:
    return flows(spark, sf_dir).drop("prediction", "label").withColumn("third", F.expr(VOTES["third"])).withColumn("label", F.expr(VOTES["label"]))


def _votes(spark, sf_dir, strategy: str, enriched: bool = False) -> DataFrame:
    """``enriched`` knows a flow's line only by the behaviour of the source."""
    def scale(df: DataFrame) -> DataFrame:
        return features.assemble(df, ["third"] if enriched else ["third", "src_port"], "scaled_features")

    rows = ["uid", "label", "third", "src_port"]
    base = materialize(_votes_flows(spark, sf_dir).select(*rows, *(["dst_ip", "dst_port", "resp_bytes"] if enriched else [])))
    base = jobs.enrich_table(base, VOTES_SPEC, rows, scale) if enriched else scale(base)
    _, tested = jobs.train(base, VOTES_SPEC, strategy, enriched)
    return tested.select("uid", "label", "prediction")


def votes_plain(spark, sf_dir):
    return _votes(spark, sf_dir, "plain")


def votes_undersampled(spark, sf_dir):
    return _votes(spark, sf_dir, "undersample")


def votes_weighted(spark, sf_dir):
    return _votes(spark, sf_dir, "weighted")


def votes_enriched(spark, sf_dir):
    return _votes(spark, sf_dir, "plain", enriched=True)


def votes_enriched_undersampled(spark, sf_dir):
    return _votes(spark, sf_dir, "undersample", enriched=True)


def votes_enriched_weighted(spark, sf_dir):
    return _votes(spark, sf_dir, "weighted", enriched=True)


def enriched_job(spark, sf_dir):
    """The job over stored stages, beside a stored plain tree: metrics of the enriched, weighted one."""
    spec = VOTES_SPEC.at(scratch_path(spark, "stages"))
    base = features.assemble(_votes_flows(spark, sf_dir), ["third"], "scaled_features")
    save(base, spec.stage(jobs.PREPROCESSED))
    model, _ = jobs.train(load(spark, spec.stage(jobs.PREPROCESSED)), spec)
    classify.save_model(model, spec.stage(jobs.TREE))
    _, found = jobs.enriched_job(spark, spec, "weighted")
    return _metrics_rounded(found["metrics"])


def tree_reload(spark, sf_dir):
    """A stored tree, applied to all flows."""
    path = scratch_path(spark, "tree")
    df = features.assemble(flows(spark, sf_dir).select("uid", "label", "duration", "orig_pkts"), ["duration", "orig_pkts"])
    classify.save_model(classify.train_tree(df, "label", "features"), path)
    return classify.predict(classify.load_model(spark, path), df).select("uid", "prediction")


# --- evaluation -----------------------------------------------------------


def confusion(spark, sf_dir):
    return evaluate.confusion(flows(spark, sf_dir), "label")


def binary_metrics(spark, sf_dir):
    return _metrics_rounded(evaluate.binary_metrics(flows(spark, sf_dir), "label"))


def benign_breakdown(spark, sf_dir):
    return evaluate.benign_breakdown(flows(spark, sf_dir), "label")


def attack_breakdown(spark, sf_dir):
    return evaluate.attack_breakdown(flows(spark, sf_dir), "label", "detailed_label")


def outcome_means(spark, sf_dir):
    found = evaluate.outcome_feature_means(
        flows(spark, sf_dir), "label", "detailed_label", features=("duration", "orig_bytes", "orig_pkts", "tunnel_parents")
    )
    return _rounded(found, ["duration", "orig_bytes", "orig_pkts"], 4)


def outcome_means_coded(spark, sf_dir):
    """Text features are averaged by their codes."""
    coded = ["conn_state", "service"]
    df = flows(spark, sf_dir).select("label", "detailed_label", "prediction", "duration", *coded)
    found = evaluate.outcome_feature_means(
        features.label_encode(df, coded), "label", "detailed_label", features=("duration", "history", *coded),
        sources={c: c + features.INDEX_SUFFIX for c in coded},
    )
    return _rounded(found, ["duration", *coded], 4)


def reports_guarded(spark, sf_dir):
    """Without an attack column the reports by attack are left out, the others stay."""
    found = jobs.reports(flows(spark, sf_dir).drop("detailed_label"), SPEC)
    counts = [df.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n_rows")) for name, df in found.items() if df is not None]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


# --- rules ----------------------------------------------------------------


def allow_rules(spark, sf_dir):
    return rules.allow_rules(flows(spark, sf_dir), FIVE_TUPLE, "clusterId")


def block_rules(spark, sf_dir):
    return rules.block_rules(flows(spark, sf_dir), FIVE_TUPLE, "clusterId")


def rule_table(spark, sf_dir):
    return rules.rule_table(flows(spark, sf_dir), FIVE_TUPLE, "clusterId")


def rule_preview(spark, sf_dir):
    """The first rules of the ordered table."""
    return rule_table(spark, sf_dir).limit(20)


def learned_rules(spark, sf_dir):
    """From flows to rules: preprocess, train on all, predict all, cross with the segments."""
    base = jobs.preprocess(flows(spark, sf_dir).drop("prediction"), SPEC).table
    model, _ = jobs.train(base, SPEC)
    return rules.rule_table(classify.predict(model, base), FIVE_TUPLE, "clusterId")


#: Of the vector that segments are looked for in.
SEGMENT_PLANE = ["duration", "orig_pkts"]


def segment_rules(spark, sf_dir):
    """All flows, clustered by source and numbered through the sources, with a tree's predictions, to rules."""
    # both vectors follow from two columns, so neither is written or joined
    df = materialize(flows(spark, sf_dir).select("uid", "label", *FIVE_TUPLE.values(), *SEGMENT_PLANE))
    plane = df.withColumn("pca_features", F.array(*[F.col(c).cast("double") for c in SEGMENT_PLANE]))
    segments = jobs.cluster_table(plane, replace(SPEC, sample_size=None), ("src_ip",))
    tree = classify.train_tree(features.assemble(df, SEGMENT_PLANE, "scaled_features"), "label")
    clustered = features.assemble(cluster.flows_in_clusters(df, segments, "uid"), SEGMENT_PLANE, "scaled_features")
    return rules.rule_table(classify.predict(tree, clustered), FIVE_TUPLE)


# --- behaviour ------------------------------------------------------------


def _profile(df: DataFrame) -> DataFrame:
    return enrich.source_profile(df, "src_ip", "dst_ip", "dst_port", "resp_bytes")


def source_profile(spark, sf_dir):
    return _rounded(_profile(flows(spark, sf_dir)), ["zero_resp_ratio"], 6)


def enrich_join(spark, sf_dir):
    df = flows(spark, sf_dir)
    return _rounded(enrich.add_behaviour(df.select("uid", "src_ip"), _profile(df), "src_ip"), ["zero_resp_ratio"], 6)


def enrich_join_salted(spark, sf_dir):
    """Equal rows beside a profile that isn't broadcast."""
    df = flows(spark, sf_dir)
    found = enrich.add_behaviour(df.select("src_ip", "proto"), _profile(df), "src_ip", rows=0)
    return _rounded(found, ["zero_resp_ratio"], 6)


def rescale_behaviour(spark, sf_dir):
    # the scaler, the profile and the join read these, none of them the flows again
    df = materialize(flows(spark, sf_dir).select("uid", "src_ip", "dst_ip", "dst_port", "orig_bytes", "resp_bytes"))
    base = features.standardize(features.assemble(df.select("uid", "src_ip", "orig_bytes"), ["orig_bytes"])).drop("features", "orig_bytes")
    wide = materialize(enrich.add_behaviour(base, _profile(df), "src_ip").drop("src_ip"))
    return _spread_vector(enrich.rescale_behaviour(wide), "enriched_features", ["orig_bytes", *enrich.PROFILE], ["uid"])


QUERIES = [
    zeek_parse, zeek_rejects, zeek_scan, csv_scan, csv_header_scan, csv_parse, csv_rejects, stage_reuse, stage_rebuilt, save_and_load, rules_csv, feature_names,
    binary_label, add_uid, add_uid_salted,
    label_encode, label_encode_large, impute_mean, standardize, corr_matrix, corr_pairs, prune_correlated, preprocess, preprocess_pruned,
    pca_norms, pca_total_variance, pca_explained_variance, pca_choose_k, pca_plane, pca_reduce,
    hash_sample, capped_sample, balanced_sample, balanced_sample_large, hash_split, undersample, class_weights, weighted_rows,
    attach_clusters, flows_in_clusters, largest_clusters, largest_clusters_all, cluster_summary, chebyshev_from_first, core_distance, reachability,
    core_distance_blocks, reachability_blocks, optics_segments_blocks,
    optics_segments, optics_by_group, flow_segments,
    tree_plain, tree_undersampled, tree_weighted, tree_enriched, tree_enriched_undersampled, tree_enriched_weighted, tree_reload,
    votes_plain, votes_undersampled, votes_weighted, votes_enriched, votes_enriched_undersampled, votes_enriched_weighted, enriched_job,
    confusion, binary_metrics, benign_breakdown, attack_breakdown, outcome_means, outcome_means_coded, reports_guarded,
    allow_rules, block_rules, rule_table, rule_preview, learned_rules, segment_rules,
    source_profile, enrich_join, enrich_join_salted, rescale_behaviour,
]

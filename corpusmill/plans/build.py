"""Dataset build and evaluation as plans: what the operators are for, from raw splits to scores."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import java, java_scan
from corpusmill.functions import text as tx
from corpusmill.operators import metrics, prep, profile, workers
from corpusmill.sources import publish, readers, writers
from corpusmill.sources.scratch import materialise

DEFAULT_PROCESSING = {"train": "prompts_with_target", "eval": "prompts_with_target", "test": "prompts_only"}
DEFAULT_TOKENIZERS = {"train": "tokenize", "eval": "tokenize", "test": "tokenize_for_inference"}


def fingerprint(config: dict, **inputs) -> str:
    return hashlib.sha256(json.dumps([config, inputs], sort_keys=True, default=str).encode()).hexdigest()


def identity(tokenizer) -> list:
    """What kind of tokenizer it is, and its parameters."""
    known = {k: getattr(v, "__qualname__", v) for k, v in vars(tokenizer).items()}
    return [type(tokenizer).__module__, type(tokenizer).__qualname__, getattr(tokenizer, "version", None), known]


def _by_split(df: DataFrame, names: dict[str, str], apply: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """apply(rows, function name), once for all splits that share a function."""
    groups: dict[str, list[str]] = {}
    for split, name in names.items():
        prep.lookup(name)
        groups.setdefault(name, []).append(split)
    out = None
    for name, splits in groups.items():
        part = apply(df.where(F.col("split").isin(splits)), name)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def process(raw: DataFrame, tokenizer, config: dict) -> DataFrame:
    """Gated prompts of all splits: raw has idx, split and the source and target columns that config names."""
    options = config.get("processing_options", {})
    return _by_split(raw, prep.resolve(config, "processing_functions", DEFAULT_PROCESSING), lambda df, name: prep.lookup(name)(df, tokenizer, **options))


def tokenize(processed: DataFrame, tokenizer, config: dict) -> DataFrame:
    length, side = config.get("max_input_len", 3584), config.get("padding_side", "right")
    out = _by_split(processed, prep.resolve(config, "tokenizer_functions", DEFAULT_TOKENIZERS), lambda df, name: prep.lookup(name)(df, tokenizer, max_input_len=length, side=side))
    return out.drop("idx", "prompt", "reference")


#: Hash buckets of each split, the grain of reuse.
BUCKETS = 16


def bucket_of(n: int) -> Column:
    return F.pmod(F.xxhash64("idx"), F.lit(n)).cast("int").alias("bucket")


def _contents_of_units(df: DataFrame, n: int, also: list[str] = ()) -> dict[tuple[str, int], list]:
    """(split, bucket) -> rows and a sum over all rows that doesn't depend on their order; splits times buckets are gathered."""
    h = F.xxhash64(*sorted(c for c in df.columns if c != "split")).cast("decimal(38,0)")
    units = df.groupBy("split", bucket_of(n).alias("bucket")).agg(F.count("*").alias("n"), F.sum(h).alias("h"))
    return {(r.split, r.bucket): [r.n, str(r.h), *also] for r in units.collect()}


class Store:
    """Units of built rows by fingerprint, in folders that are written once and never change, and the builds that are made of them.

    A unit is the rows of one split and hash bucket. Its data are written to a folder of the build that makes it, then its fingerprint is
    claimed by a small file that names that folder (`publish_once`), so a unit is there whole or not at all and a lost build leaves
    nothing that any other would read. A build is a list of units, published under the next number after all of them: readers of the latest
    build see one build whole while the next is made.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def known(self, kind: str) -> set[str]:
        return set(publish.names(self.spark, f"{self.root}/units/{kind}"))

    def unit(self, kind: str, key: str) -> dict:
        return json.loads(publish.read_text(self.spark, f"{self.root}/units/{kind}/{key}"))

    def make(self, kind: str, df: DataFrame, keys: dict[tuple[str, int], str]) -> dict[str, dict]:
        """Writes the rows of df (split, bucket, ...) as units of these keys, in one job, and claims them."""
        path = f"{self.root}/data/{kind}-{uuid.uuid4().hex}"
        place = self.spark.createDataFrame([(s, b, k) for (s, b), k in keys.items()], "split string, bucket int, unit string")
        rows = df.join(F.broadcast(place), ["split", "bucket"])  # one row for each unit: splits times buckets
        rows.write.partitionBy("unit").parquet(path)
        counts = {r.unit: r["count"] for r in self.spark.read.parquet(path).groupBy("unit").count().collect()} if publish.names(self.spark, path) else {}
        made = {}
        for key in keys.values():
            made[key] = {"path": f"{path}/unit={key}" if counts.get(key) else None, "rows": counts.get(key, 0)}
            publish.publish_once(self.spark, f"{self.root}/units/{kind}/{key}", json.dumps(made[key]))
        return made

    def ensure(self, kind: str, keys: dict[tuple[str, int], str], make: Callable[[list], DataFrame], force: bool = False) -> dict[str, dict]:
        """Key -> unit of all keys; make(splits and buckets) gives the rows of those that aren't there. `made` counts them."""
        known = set() if force else self.known(kind)
        units = {k: self.unit(kind, k) for k in keys.values() if k in known}
        missing = {u: k for u, k in keys.items() if k not in units}
        if missing:
            units |= self.make(kind, make(list(missing)), missing)
        return units

    def read(self, units: Iterable[dict], schema: T.StructType) -> DataFrame:
        paths = [u["path"] for u in units if u["path"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish_build(self, content: dict) -> None:
        """Makes a build the latest, unless it is that already."""
        text = json.dumps(content, sort_keys=True)
        while self.latest_text() != text:
            there = publish.names(self.spark, f"{self.root}/builds")
            publish.publish_once(self.spark, f"{self.root}/builds/{int(there[-1]) + 1 if there else 1:012d}", text)

    def latest_text(self) -> str | None:
        there = publish.names(self.spark, f"{self.root}/builds")
        return publish.read_text(self.spark, f"{self.root}/builds/{there[-1]}") if there else None

    def latest(self) -> dict:
        text = self.latest_text()
        if text is None:
            raise FileNotFoundError(f"nothing has been built in {self.root}")
        return json.loads(text)


def read_build(spark: SparkSession, root: str, kind: str = "tokenized", split: str | None = None) -> DataFrame:
    """The latest build's rows of a kind (`processed` or `tokenized`), of all splits or of one, whose units alone are then read."""
    store = Store(spark, root)
    content = store.latest()[kind]
    units = [u for u in content["units"] if split in (None, u["split"])]
    return store.read(units, T.StructType.fromJson(content["schema"])).drop("bucket")


def build_datasets(spark: SparkSession, config: dict, tokenizer, raw: DataFrame | None = None) -> DataFrame:
    """Tokenized splits: raw -> gate and prompts -> written -> indices shared by all models -> tokens -> written.

    Rows are made in units of a split and a hash bucket of idx (`buckets` of the configuration, or BUCKETS). A unit's fingerprint is that of
    the configuration, the tokenizer and the unit's input: its raw rows, and for tokens also the shared indices. A unit that is there is used again, so
    of an input that changed in part only the changed buckets are made anew, and an earlier input is there at once. need_special_processing and
    need_tokenization ask for prompts or tokens to be made anew. See `Store` for what a lost build leaves.
    """
    store, n = Store(spark, config["output_dir"]), config.get("buckets", BUCKETS)
    src = raw if raw is not None else readers.read_splits(spark, config["paths"])
    src = src if "idx" in src.columns else prep.with_index(src)
    settings = [{k: v for k, v in config.items() if not k.startswith("need_") and k not in ("output_dir", "paths", "registry")}, identity(tokenizer), src.schema.json()]
    anew = bool(config.get("need_special_processing"))
    inside = lambda df, units: df.withColumn("bucket", bucket_of(n)).join(F.broadcast(spark.createDataFrame(units, "split string, bucket int")), ["split", "bucket"], "left_semi")

    keys = {u: fingerprint({"unit": u, "settings": settings}, rows=c) for u, c in _contents_of_units(src, n).items()}
    schemas_ = {"processed": T.StructType.fromJson(process(src, tokenizer, config).withColumn("bucket", F.lit(0)).schema.jsonValue())}
    processed_units = store.ensure("processed", keys, lambda units: process(inside(src, units).drop("bucket"), tokenizer, config).withColumn("bucket", bucket_of(n)), anew)
    processed = store.read(processed_units.values(), schemas_["processed"])

    shared = {}
    if config.get("registry"):
        index = prep.shared_index(readers.read_registered_index(spark, readers.read_registry(spark, config["registry"])))
        shared = _contents_of_units(index, n)
        processed = prep.fairness_filter(processed, index)
    some = {s for s, _ in shared}
    token_keys = {u: fingerprint({"processed": k}, shared=shared.get(u) if u[0] in some else None, fair=u[0] in some) for u, k in keys.items()}
    with_bucket = lambda df: tokenize(df, tokenizer, config)
    schemas_["tokenized"] = with_bucket(processed).schema
    token_units = store.ensure("tokenized", token_keys, lambda units: with_bucket(processed.join(F.broadcast(spark.createDataFrame(units, "split string, bucket int")), ["split", "bucket"], "left_semi")), anew or bool(config.get("need_tokenization")))
    kinds = {"processed": (keys, processed_units), "tokenized": (token_keys, token_units)}
    store.publish_build({kind: {"schema": schemas_[kind].jsonValue(), "units": [{"split": u[0], "bucket": u[1], **units[k]} for u, k in sorted(own.items())]} for kind, (own, units) in kinds.items()})
    return store.read(token_units.values(), schemas_["tokenized"]).drop("bucket")


def dry_run(spark: SparkSession, config: dict, tokenizer, raw: DataFrame | None = None, previews: int = 2) -> dict[str, DataFrame]:
    """Counts, token statistics and previews of a build, and whether indices are shared."""
    tokens = build_datasets(spark, config, tokenizer, raw)
    processed = read_build(spark, config["output_dir"], "processed")
    shown = processed.orderBy("split", "idx").limit(previews).select("split", "idx", tx.preview(F.col("prompt")).alias("preview"))
    shared = spark.createDataFrame([(bool(config.get("registry")),)], "fairness boolean")
    return {"counts": processed.groupBy("split").count(), "stats": profile.tokenized_stats(tokens.where("labels is not null"), ["split"]), "previews": shown, "fairness": shared}


def infer(df: DataFrame, make, root: str, label: str, run: str, n: int | None = None, batch_size: int = 128, score: bool = False) -> tuple[str, DataFrame | None]:
    """Generates predictions for the first n prompts, writes them, and scores them if there are references."""
    some = prep.first_rows(df, n)
    path = writers.write_predictions(workers.generate(some, make, batch_size=batch_size), root, label, run)
    if not score:
        return path, None
    written = some.sparkSession.read.schema("idx bigint, prediction string").json(path)
    return path, evaluate(some, written, names=["bleu", "edit_distance", "exact_match"])


def evaluation_frame(prompts: DataFrame, predictions: DataFrame, model: str = "chatml", n: int | None = None) -> DataFrame:
    """(idx, prediction, reference): a prompt's own reference, or the one in its chat."""
    dialect = tx.dialect_of(model)
    in_chat = tx.extract_reference(F.col("prompt"), dialect)
    ref = F.coalesce("reference", in_chat) if "reference" in prompts.columns else in_chat
    return metrics.align(prep.first_rows(predictions, n), prep.first_rows(prompts, n).select("idx", ref.alias("reference")))


def evaluate(prompts: DataFrame, predictions: DataFrame, model: str = "chatml", names: list[str] | None = None, cascade: bool = True, n: int | None = None, classpath: str = "", coverage: DataFrame | None = None, partitions: int | None = None, store: str | None = None) -> DataFrame:
    """A row for each metric. Parsing and compiling run only if a metric asks for them, once for each distinct source; coverage: (idx, coverage) as coverage_of() gives it.

    partitions: over how many the rows are dealt before; by default they stay as they are. store: where answers of the parser and compiler are kept across runs.
    """
    ev = evaluation_frame(prompts, predictions, model, n)
    ev = ev.repartition(partitions) if partitions else ev
    wanted = list(names or metrics.REGISTRY)
    if coverage is not None:
        ev = ev.join(coverage.select("idx", "coverage"), "idx", "left")
    elif "coverage" not in ev.columns and "coverage" in wanted:
        wanted.remove("coverage")
    if "parse_rate" in wanted:
        ev = workers.parse_java(ev, store=store)
    if "compile_rate" in wanted:
        ev = workers.with_status(ev, classpath=classpath, store=store)
    return metrics.run_metrics(ev, wanted, cascade)


def coverage_tests(tests: DataFrame, focal: DataFrame) -> DataFrame:
    """(idx, test_src, test_path, focal_src, focal_path, focal_name, class_name) of tests (original_idx, prediction) and focal sources (idx, src)."""
    spark = tests.sparkSession
    # joined rows are so short that a few tasks would be left with all of them, but each costs a millisecond here and may cost seconds later
    pairs = metrics.gather(tests, focal).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    renamed = java.uniquify_test(F.col("original_idx"), F.col("prediction"), generated_only=True)
    fixed = java_scan.normalize_focal(F.col("src"))
    rows = pairs.select(F.col("original_idx").alias("idx"), renamed.alias("t"), fixed.alias("focal_src"))
    name = F.regexp_extract("focal_src", "\\bclass\\s+(\\w+)", 1)
    return rows.select(
        "idx", F.col("t.src").alias("test_src"), F.col("t.rel_path").alias("test_path"), "focal_src", F.concat(java.package_path(F.col("focal_src")), name, F.lit(".java")).alias("focal_path"),
        java.focal_method_name(F.col("focal_src")).alias("focal_name"), name.alias("class_name"),
    )


def coverage_of(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """(idx, coverage) of every row of pairs (idx, focal_name, class_name): line coverage of its focal method by its report (idx, report); 0 without one."""
    counters = readers.coverage_methods(reports.where("report is not null").select(F.col("idx").alias("test_idx"), "report"))
    return metrics.focal_coverage(counters, pairs.select(F.col("idx").alias("test_idx"), "focal_name", "class_name")).withColumnRenamed("test_idx", "idx")


def run_coverage(tests: DataFrame, focal: DataFrame, junit_classpath: str, agent_jar: str, cli_jar: str, allow_execution: bool = False, save_reports: str | None = None, timeout_s: int = 30) -> DataFrame:
    """(idx, coverage) of tests that are compiled and run under the coverage agent; a test of which any step fails has 0."""
    pairs = coverage_tests(tests, focal)
    reports = workers.run_coverage(pairs, junit_classpath, agent_jar, cli_jar, allow_execution, timeout_s)
    if save_reports:  # written once, so that tests don't run again for the figures
        writers.write_reports(reports, save_reports)
        reports = tests.sparkSession.read.parquet(save_reports)
    return coverage_of(pairs, reports)


def compile_report(spark: SparkSession, predictions_path: str, out: str | None = None, errors: str | None = None, classpath: str = "", java_dir: str | None = None, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary by status, results) of a predictions file; both written where paths are given. Results keep original_idx. store: where answers of the compiler are kept across runs."""
    results = materialise(workers.compile_java(readers.read_predictions(spark, predictions_path), idx="original_idx", classpath=classpath, store=store), "compiled")
    if out:
        writers.write_corrected_tests(results, out, java_dir=java_dir)
    if errors:
        writers.write_failures(results, errors)
    return metrics.status_counts(results), results


def profile_lengths(df: DataFrame, tokenizer, source_col: str = "src_fm_fc_ms", target_col: str = "target", instruction: str = prep.INSTRUCTION) -> DataFrame:
    """Length profiles of prompts without and with their answers, and of the answers."""
    user = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(instruction), F.col(source_col)).alias("content")))
    answer = F.array(F.struct(F.lit("assistant").alias("role"), F.col(target_col).alias("content")))
    forms = {"input": tx.render_chat(user, add_generation_prompt=False), "input_and_target": tx.render_chat(F.concat(user, answer), add_generation_prompt=False), "target": F.coalesce(target_col, F.lit(""))}
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("part"), v.alias("text")) for k, v in forms.items()))).alias("x")).select("x.*")
    return profile.length_profile(rows, tokenizer.count(F.col("text")), ["part"])

"""The whole run: folder to validated, append-only published corpus, one table per stage."""

from __future__ import annotations

import json
import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..operators import chunking, custody, extraction, intake, merkle, reconcile, reports, validate
from ..schemas import CUSTODY, PUBLISHED_CHUNKS, RunConfig
from ..session import ROOT, exists, local_path, read_bytes, utc_now
from ..sources import enclave, files, sinks


VAULT = "sha256 string, content binary, prefix string"


class StageFailed(RuntimeError):
    """A stage whose failure rows aren't empty; nothing after it runs."""

    def __init__(self, stage: str, failures: list):
        super().__init__(f"{stage}: {len(failures)} failure(s), first {failures[0] if failures else ''}")
        self.failures = failures


def code_tree_sha256(root: str = os.path.join(ROOT, "millrace")) -> str:
    """A hash over the package's source files, by path."""
    import hashlib

    h = hashlib.sha256()
    for folder, subfolders, names in os.walk(root):
        subfolders.sort()
        for name in sorted(n for n in names if n.endswith(".py")):
            path = os.path.join(folder, name)
            with open(path, "rb") as f:
                h.update(os.path.relpath(path, root).encode() + b"\0" + f.read() + b"\0")
    return h.hexdigest()


def gate(path: str, name: str, config: RunConfig, passed: bool) -> None:
    sinks.write_json(os.path.join(path, f"{name}.json"), {"gate": name, "passed": passed, "code_tree_sha256": code_tree_sha256(), "config_sha256": hs.sha256_json(asdict(config))})


def gate_is_fresh(path: str, name: str, config: RunConfig) -> bool:
    """Whether a gate passed with this code and this configuration."""
    held = files.load_json(os.path.join(path, f"{name}.json"), {}, SparkSession.getActiveSession())
    return bool(held.get("passed")) and held.get("code_tree_sha256") == code_tree_sha256() and held.get("config_sha256") == hs.sha256_json(asdict(config))


class Run:
    """Stages over a work folder (shared by the executors): each reads the tables before it and writes its own."""

    def __init__(self, spark: SparkSession, source: str, work: str, output: str, config: RunConfig = RunConfig(), utc: str | None = None):
        self.spark, self.source, self.work, self.output, self.config = spark, source, work, output, config
        self.utc = utc or utc_now()
        self.run_id = hs.sha256_json({"source": source, "utc": self.utc})[:16]

    def _save(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.work}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(VAULT) if name == "vault" else self.spark.read
        return reader.parquet(f"{self.work}/{name}")

    def _note(self, kind: str, **details) -> None:
        custody.append(f"{self.work}/custody.jsonl", kind, details, self.utc)

    def _require(self, stage: str, failures: DataFrame) -> None:
        found = validate.preview(failures).collect()
        gate(self.work, stage, self.config, not found)
        if found:
            raise StageFailed(stage, found)

    def _walk(self) -> DataFrame:
        """Every file of the source as it is now, judged."""
        found = files.candidates(self.spark, self.source, self.config.max_file_bytes)
        if local_path(self.source):  # a local folder: what the source leaves out (links, special and empty files) is listed on the driver
            odd = files.listed(self.spark, self.source).where("problem IS NOT NULL OR size_bytes = 0").withColumn("content", F.lit(None).cast("binary")).withColumn("mtime_utc", F.lit(None).cast("string"))
        else:
            odd = files.empty_files(self.spark, self.source).withColumn("problem", F.lit(None).cast("string")).withColumn("content", F.lit(None).cast("binary")).withColumn("mtime_utc", F.lit(None).cast("string"))
        found = found.withColumn("problem", F.lit(None).cast("string")).join(odd.select("relpath"), "relpath", "left_anti").unionByName(odd)
        return intake.judged(found, self.config)

    def _objects(self) -> DataFrame:
        """The vault's objects that a record names; what was rejected as a bad copy is none of them."""
        return self.table("vault").join(self.table("records").select("sha256"), "sha256", "left_semi")

    def scan(self) -> None:
        """Reads every file once, lists them again to find those that changed meanwhile, and hashes the copies in the vault."""
        read = self._save("read", self._walk())
        changed = self._save("changed", intake.changed(read, files.states(self.spark, self.source)))
        sinks.write_vault(intake.vault(read.join(changed, "relpath", "left_anti")), f"{self.work}/vault")
        bare = read.drop("content")
        miscopied = self._save("miscopied", intake.miscopied(bare, self.table("vault")))
        judged = self._save("judged", intake.captured(bare, changed, miscopied))
        self._save("records", intake.records(judged, self.utc))
        self._save("drops", intake.drops(judged, self.utc))
        self._note("scan_completed", records=self.table("records").count(), drops=self.table("drops").count())

    def extract(self, ocr: DataFrame | None = None) -> None:
        made = extraction.extract(self.table("records"), self.table("vault"), ocr)
        self._save("bundles", extraction.extraction_sha(made))
        self._note("extract_completed", bundles=self.table("bundles").count())

    def export_requests(self, folder: str) -> int:
        """Hands the objects that need recognition to a host without a network."""
        n = enclave.export(self.table("records"), self.table("vault"), folder)
        self._note("requests_exported", requests=n)
        return n

    def import_responses(self, folder: str) -> int:
        """Takes in what the host recognised, and extracts with it; requests that were changed stop it."""
        try:
            raw, status = enclave.responses(self.spark, self.table("records"), folder)
        except enclave.Tampered as wrong:
            raise StageFailed("import", [str(wrong)]) from wrong
        raw = self._save("ocr_raw", raw)
        counts = {r[0]: r[1] for r in reports.census(self._save("ocr_status", status), "status").collect()}
        self._note("responses_imported", counts=counts)
        self.extract(files.recognised(raw))
        return counts.get("succeeded", 0)

    def chunk(self) -> None:
        """Stops before anything is written if a record has no bundle."""
        self._require("chunk", validate.missing_bundles(self.table("records"), self.table("bundles")))
        made = chunking.chunks(self.table("bundles"), self.table("records"), self.run_id, self.config.chunk_target, self.config.chunk_overlap, code_tree_sha256())
        self._save("chunks", made)
        self._note("chunk_completed", chunks=self.table("chunks").count())

    def validate(self) -> None:
        """Accepted and dropped files against a fresh walk and hash of the source, native text against a second extraction, and the tables against each other."""
        records, objects, bundles, chunks = self.table("records"), self._objects(), self.table("bundles"), self.table("chunks")
        walked = self._save("walked", self._walk().select("relpath", "sha256"))
        occurrences = records.select(F.explode("occurrences.relpath").alias("relpath"), "sha256")
        accepted = records.select(F.explode("occurrences.relpath").alias("relpath"))
        ledger = reconcile.reconcile(walked.select("relpath"), accepted, self.table("drops").select("relpath"))
        ledger = ledger.select(F.lit("ledger").alias("check"), F.col("relpath").alias("subject"), F.col("failure").alias("detail"))
        self._require("validate", validate.union(
            ledger, validate.sources(occurrences, walked), validate.reparse(bundles, extraction.extract(records, objects)), validate.vault(objects), validate.missing_objects(records, objects), validate.missing_bundles(records, bundles), validate.paths(records),
            validate.vocabulary(records), validate.chunk_failures(chunks, bundles), validate.orphans(chunks, objects)))
        self._note("validate_completed", passed=True)

    def _published(self, name: str, like: DataFrame) -> DataFrame:
        path = f"{self.output}/{name}"
        return self.spark.read.schema(like.schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], like.schema)

    def merge(self) -> int:
        """Appends what isn't published yet; returns the number of new chunks.  A published object with other content stops the merge before anything is written."""
        if not gate_is_fresh(self.work, "validate", self.config):
            raise StageFailed("merge", ["validation is missing or stale"])
        documents = reports.documents(self.table("bundles"), self.table("records")).join(self.table("bundles").select(F.col("source_sha256").alias("sha256"), "extraction_sha256"), "sha256")
        chunks = self.table("chunks").select(*PUBLISHED_CHUNKS)
        old_docs, old_chunks = self._published("documents", documents), self._published("chunks", chunks)
        clash = reconcile.upsert_plan(documents, old_docs, "sha256", "extraction_sha256").where("action = 'conflict'").limit(50).collect()
        if clash:
            raise StageFailed("merge", clash)
        sinks.write_vault(self._objects(), f"{self.output}/evidence")
        new = self._save("new_chunks", reconcile.only_new(chunks, old_chunks, "chunk_id"))
        self._save("new_documents", reconcile.only_new(documents, old_docs, "sha256")).write.mode("append").parquet(f"{self.output}/documents")
        new.write.mode("append").parquet(f"{self.output}/chunks")
        sinks.canonical_lines(new).write.mode("append").option("lineSep", "\n").text(f"{self.output}/chunks_jsonl")
        count = new.count()
        self._note("merge_completed", chunks_appended=count)
        self._seal()
        return count

    def _manifest(self) -> DataFrame:
        """Logical manifest: one line per published object."""
        docs = self.spark.read.parquet(f"{self.output}/documents")
        return docs.select("sha256", hs.vault_path(F.col("sha256")).alias("relpath"))

    def _seal(self) -> None:
        chunks, docs = (self.spark.read.parquet(f"{self.output}/{n}") for n in ("chunks", "documents"))
        sinks.write_json(f"{self.output}/seal.json", merkle.corpus_roots(chunks, docs, self._manifest()).first().asDict())
        sinks.write_manifest(self._manifest(), f"{self.output}/manifest")
        sinks.write_index(reports.index(self.table("records"), chunks, reports.ocr_status(self.table("bundles"))), f"{self.output}/index")
        found = reports.audit(self.table("records"), self.table("drops"), chunks)
        sinks.write_json(f"{self.output}/audit.json", found)
        sinks.write_text(f"{self.output}/report.md", reports.markdown(found))

    def _custody_failures(self) -> DataFrame:
        path = f"{self.work}/custody.jsonl"
        events = []
        log = (read_bytes(self.spark, path) or b"").decode()  # the driver wrote it, an event a stage
        for k, line in enumerate(x for x in log.split("\n") if x.strip()):
            e = json.loads(line)
            events.append((k + 1, e["sequence"], e["utc"], e["event"], hs.canonical(e["details"]), e["prev_sha256"], e["event_hash"]))
        checked = custody.checked(self.spark.createDataFrame(events, f"line_no bigint, {CUSTODY}")).where("error IS NOT NULL")
        return checked.select(F.lit("custody").alias("check"), F.col("line_no").cast("string").alias("subject"), F.col("error").alias("detail"))

    def verify(self) -> None:
        """The published corpus against itself: object hashes, texts, chunk ids, sources, manifest and unlisted objects, lines and table of the chunks, and the seal; and the run's custody chain."""
        chunks, docs = (self.spark.read.parquet(f"{self.output}/{n}") for n in ("chunks", "documents"))
        objects = self.spark.read.schema(VAULT).parquet(f"{self.output}/evidence")  # without any object there is no file to infer it from
        seal = self.spark.createDataFrame([files.load_json(f"{self.output}/seal.json", {}, self.spark)], "chunks_root string, documents_root string, manifest_root string, chunks string, documents string")
        lines = self.spark.read.text(f"{self.output}/chunks_jsonl").where("value <> ''")
        ids = lines.select(F.get_json_object("value", "$.chunk_id").alias("chunk_id"))
        stored = objects.select("sha256", hs.vault_path(F.col("sha256")).alias("relpath")).distinct()
        self._require("verify", validate.union(
            self._custody_failures(), validate.manifest(files.manifest(self.spark, f"{self.output}/manifest"), stored),
            validate.published_ids(chunks), validate.closed(lines, chunks.schema.simpleString()[7:-1]), validate.id_parity(chunks, ids),
            validate.vault(objects), validate.text_hashes(chunks), validate.orphans(chunks, objects), validate.missing_objects(docs, objects), validate.seal(seal, chunks, docs, self._manifest())))
        for name in ("chunks", "documents"):
            self.spark.read.parquet(f"{self.output}/{name}").createOrReplaceTempView(name)

    def all(self) -> int:
        self.scan()
        self.extract()
        self.chunk()
        self.validate()
        added = self.merge()
        self.verify()
        return added

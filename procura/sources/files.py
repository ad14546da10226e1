"""File sources: labelled ground truth (JSON), document listings, page texts
(S-3, S-4, S-5, S-6, S-14, J-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import unsorted_partitions

# Fixed value: the contract key inside a document's file name (first match).
DOC_KEY_PATTERN = r"(CON-\d+)"

GROUND_TRUTH_INVOICE = ("struct<invoice_number:string,expected_status:string,check_type:string,"
                        "expected_agreed_price:double,expected_invoiced_price:double,reason:string,note:string>")
GROUND_TRUTH_TENANT = (f"struct<tenant_id:string,tenant_name:string,tenant_label:string,"
                       f"invoices:array<{GROUND_TRUTH_INVOICE}>>")
GROUND_TRUTH_FLAT = ("tenant_id string, tenant_name string, tenant_label string, invoice_number string, "
                     "expected_status string, check_type string, expected_agreed_price double, "
                     "expected_invoiced_price double, reason string, note string")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """S-3: the nested ground-truth document ``{tenants: [{…, invoices: [...]}]}``
    flattened to one row per labelled invoice (explicit schema, no inference)."""
    doc = spark.read.schema(f"tenants array<{GROUND_TRUTH_TENANT}>").option("multiLine", True).json(path)
    t = doc.select(F.explode("tenants").alias("t"))
    return t.select(F.col("t.tenant_id"), F.col("t.tenant_name"), F.col("t.tenant_label"),
                    F.explode("t.invoices").alias("i")).select("tenant_id", "tenant_name", "tenant_label", "i.*")


def read_ground_truth_lines(spark: SparkSession, path: str) -> DataFrame:
    """S-3 for large label sets: JSON Lines, one labelled invoice per line."""
    return spark.read.schema(GROUND_TRUTH_FLAT).json(path)


def write_ground_truth_lines(labels: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """S-14: labels as JSON Lines partitioned by tenant (one invoice per line, so no
    tenant's labels are gathered into a single document)."""
    with unsorted_partitions(labels.sparkSession):
        labels.write.mode(mode).option("compression", compression).partitionBy("tenant_id").json(path)


def read_golden(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S-4: the golden extraction file's three sections as flat frames."""
    schema = ("contracts array<struct<file:string,expected:struct<contract_number:string,"
              "items:array<struct<item_sku:string,agreed_unit_price:double>>>>>, "
              "invoices array<struct<file:string,expected:struct<invoice_number:string,quantity_billed:int,"
              "invoice_unit_price:double,total_amount:double>>>, "
              "citation_questions array<struct<question:string,expected_contract:string,expected_page:int>>")
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return {
        "contracts": doc.select(F.explode("contracts").alias("c")).select(
            F.col("c.file").alias("file"), F.col("c.expected.contract_number").alias("contract_number"),
            F.col("c.expected.items").alias("items")),
        "invoices": doc.select(F.explode("invoices").alias("c")).select(F.col("c.file").alias("file"), "c.expected.*"),
        "citation_questions": doc.select(F.explode("citation_questions").alias("c")).select("c.*"),
    }


def list_documents(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """S-5: files under ``root`` matching ``glob`` as (path, file_name, length).
    The content column is never selected, so file bodies are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", True).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def doc_keys(docs: DataFrame, name_col: str = "file_name") -> DataFrame:
    """S-5: the contract key found in each file name (NULL when none)."""
    return docs.withColumn("contract_number",
                           F.nullif(F.regexp_extract(F.col(name_col), DOC_KEY_PATTERN, 1), F.lit("")))


def doc_key_match(docs: DataFrame, contracts: DataFrame, name_col: str = "file_name") -> DataFrame:
    """S-5 / J-6: documents whose key names a contract of their own tenant, with the contract id.
    ``docs`` and ``contracts`` both have ``tenant_id``."""
    c = contracts.select("tenant_id", "contract_number", "contract_id")
    return doc_keys(docs, name_col).join(c, ["tenant_id", "contract_number"], "inner")


def doc_key_skipped(docs: DataFrame, contracts: DataFrame, name_col: str = "file_name") -> DataFrame:
    """S-5 / J-6: documents skipped, with the reason (no key in the name, or a key
    that names no contract of the document's tenant)."""
    k = doc_keys(docs, name_col)
    unknown = k.where(F.col("contract_number").isNotNull()) \
        .join(contracts.select("tenant_id", "contract_number"), ["tenant_id", "contract_number"], "left_anti") \
        .withColumn("reason", F.lit("unknown contract"))
    nokey = k.where(F.col("contract_number").isNull()).withColumn("reason", F.lit("no key in name"))
    return unknown.unionByName(nokey)


def document_text(pages: DataFrame, doc_col: str, page_col: str = "page_number",
                  text_col: str = "page_text") -> DataFrame:
    """S-6: whole-document text = page texts in page order joined by a newline (empty
    pages kept). One value per document, so its size is that of the document."""
    g = pages.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct(page_col, text_col))).alias("_p"))
    return g.select(doc_col, F.array_join(F.transform("_p", lambda p: F.coalesce(p[text_col], F.lit(""))), "\n")
                    .alias("document_text"))

"""Source queries (S-3 / S-14 round trip, S-5, S-6, J-6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import files as fl
from ..sources import fixtures as fx
from ..sources.tables import Tables
from .registry import query


def document_files(t: Tables):
    """File names for the documents: most carry a contract key, some do not."""
    cid = F.floor(F.col("doc_id") / 8).cast("bigint")
    name = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("notes_"), F.col("doc_id").cast("string"), F.lit(".txt"))) \
        .otherwise(F.concat(F.lit("CON-"), cid.cast("string"), F.lit("_"), F.col("source"), F.lit(".pdf")))
    return t.documents.select("doc_id", (cid % 5).alias("tenant_id"), name.alias("file_name"))


_FILES = """
, files as (select doc_id, cast(floor(doc_id / 8) as bigint) % 5 as tenant_id,
                     case when doc_id % 9 = 0 then 'notes_' || doc_id || '.txt'
                                else 'CON-' || cast(floor(doc_id / 8) as bigint) || '_' || source || '.pdf' end
                             as file_name from documents)
, keyed as (select *, nullif(regexp_extract(file_name, '(CON-\\d+)', 1), '') as contract_number from files)
"""


@query("doc_key_match", _FILES + """
select k.tenant_id, k.contract_number, k.doc_id, k.file_name, c.contract_id
from keyed k join contracts c on c.tenant_id = k.tenant_id and c.contract_number = k.contract_number""", ("contracts",))
def q_doc_key_match(t: Tables):
    """S-5 / J-6: documents matched to contracts by the key in their file name."""
    return fl.doc_key_match(document_files(t), fx.contracts(t))


@query("doc_key_skipped", _FILES + """
select tenant_id, contract_number, doc_id, file_name, 'unknown contract' as reason from keyed k
where contract_number is not null and not exists (
  select 1 from contracts c where c.tenant_id = k.tenant_id and c.contract_number = k.contract_number)
union all
select tenant_id, contract_number, doc_id, file_name, 'no key in name' from keyed where contract_number is null""",
       ("contracts",))
def q_doc_key_skipped(t: Tables):
    """S-5: documents skipped and why."""
    return fl.doc_key_skipped(document_files(t), fx.contracts(t))


@query("document_text", """
select contract_id, string_agg(page_text, chr(10) order by page_number) as document_text
from contract_pages group by contract_id""", ("contract_pages",))
def q_document_text(t: Tables):
    """S-6: whole contract text from its pages."""
    return fl.document_text(fx.contract_pages(t), "contract_id")


@query("ground_truth_flat", """
select cast(i.tenant_id as varchar) as tenant_id, t.name as tenant_name, lower(t.name) as tenant_label,
       l.invoice_id as invoice_number, l.expected_status, l.expected_check_type as check_type,
       cast(null as double) as expected_agreed_price, cast(null as double) as expected_invoiced_price,
       'derived from raw columns' as reason, cast(null as varchar) as note
from expected_labels l join invoices i on i.tenant_id = l.tenant_id and i.invoice_id = l.invoice_id
join tenants t on t.tenant_id = i.tenant_id""", ("expected_labels", "invoices", "tenants"))
def q_ground_truth_flat(t: Tables):
    """S-14 then S-3: labels written as JSON Lines by tenant and read back with a schema."""
    inv = fx.invoices(t).select("invoice_id", "tenant_id")
    ten = fx.tenants(t)
    labels = fx.expected_labels(t).join(inv, ["tenant_id", "invoice_id"]).join(ten, "tenant_id").select(
        F.col("tenant_id").cast("string").alias("tenant_id"), F.col("name").alias("tenant_name"),
        F.lower("name").alias("tenant_label"), F.col("invoice_id").alias("invoice_number"), "expected_status",
        F.col("expected_check_type").alias("check_type"),
        F.lit(None).cast("double").alias("expected_agreed_price"),
        F.lit(None).cast("double").alias("expected_invoiced_price"),
        F.lit("derived from raw columns").alias("reason"), F.lit(None).cast("string").alias("note"))
    path = shared_path(t.spark, f"ground_truth/{uuid.uuid4().hex}")
    fl.write_ground_truth_lines(labels, path, compression="gzip")
    return fl.read_ground_truth_lines(t.spark, path)

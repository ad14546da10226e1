"""Reconciliation queries (C-1 .. C-8, U-1, A-3)."""

from __future__ import annotations

from ..operators import reconcile as rc
from ..sources import fixtures as fx
from ..sources.tables import Tables
from .registry import query

# Shared oracle pieces --------------------------------------------------------
_MATCH = """
, m as (
  select i.tenant_id, i.invoice_id, i.supplier_id, i.invoice_unit_price, i.invoice_date,
         ci.agreed_unit_price
  from invoices i left join contract_items ci
    on ci.tenant_id = i.tenant_id and ci.supplier_id = i.supplier_id
   and ci.item_sku = i.item_sku and ci.is_active = true)
, pc as (
  select tenant_id, invoice_id, supplier_id,
         case when agreed_unit_price is null then 'MISSING_CONTRACT'
              when agreed_unit_price > 0
                   and invoice_unit_price - agreed_unit_price > 0.05 * agreed_unit_price then 'PRICE_VARIANCE'
              when agreed_unit_price < 0
                   and invoice_unit_price - agreed_unit_price < 0.05 * agreed_unit_price then 'PRICE_VARIANCE'
         end as check_type,
         cast(agreed_unit_price as decimal(18,5)) as expected_value,
         cast(invoice_unit_price as decimal(18,5)) as actual_value,
         cast(invoice_unit_price - agreed_unit_price as decimal(18,5)) as variance_amount,
         case when agreed_unit_price is null then 'HIGH'
              when agreed_unit_price > 0
                   and invoice_unit_price - agreed_unit_price > 0.15 * agreed_unit_price then 'HIGH'
              when agreed_unit_price < 0
                   and invoice_unit_price - agreed_unit_price < 0.15 * agreed_unit_price then 'HIGH'
              else 'MEDIUM' end as severity,
         cast(invoice_date as timestamp) as detected_at
  from m)
, dup_keys as (
  select tenant_id, po_id, count(*) as n_invoices from invoices
  where po_id is not null group by tenant_id, po_id having count(*) > 1)
, dp as (
  select i.tenant_id, i.invoice_id, i.supplier_id, 'DUPLICATE_PO' as check_type,
         cast(null as decimal(18,5)) as expected_value, cast(null as decimal(18,5)) as actual_value,
         cast(null as decimal(18,5)) as variance_amount, 'HIGH' as severity,
         cast(i.invoice_date as timestamp) as detected_at
  from invoices i join dup_keys d on d.tenant_id = i.tenant_id and d.po_id = i.po_id)
, results as (
  select * from pc where check_type is not null
  union all select * from dp)
"""
_FX = ("invoices", "contract_items")


def results(t: Tables):
    return rc.reconcile(fx.invoices(t), fx.contract_items(t))


@query("reconcile", _MATCH + "select * from results", _FX)
def q_reconcile(t: Tables):
    """C-7: all result rows of a full reconciliation run, all tenants."""
    return results(t)


@query("contract_match", """
select i.tenant_id, i.invoice_id, i.supplier_id, i.item_sku,
       cast(i.invoice_unit_price as decimal(18,5)) as invoice_unit_price, i.invoice_date,
       cast(ci.agreed_unit_price as decimal(18,5)) as agreed_unit_price
from invoices i left join contract_items ci
  on ci.tenant_id = i.tenant_id and ci.supplier_id = i.supplier_id
 and ci.item_sku = i.item_sku and ci.is_active = true""", _FX)
def q_contract_match(t: Tables):
    """C-1 / J-1: invoice rows with every matching active contract item."""
    return rc.contract_match(fx.invoices(t), fx.contract_items(t))


@query("missing_contract", _MATCH + "select * from pc where check_type = 'MISSING_CONTRACT'", _FX)
def q_missing_contract(t: Tables):
    """C-2."""
    return rc.missing_contract(fx.invoices(t), fx.contract_items(t)).select(*rc.RESULT_COLUMNS)


@query("price_variance", _MATCH + "select * from pc where check_type = 'PRICE_VARIANCE'", _FX)
def q_price_variance(t: Tables):
    """C-3 / C-4."""
    return rc.price_variance(fx.invoices(t), fx.contract_items(t)).select(*rc.RESULT_COLUMNS)


@query("duplicate_po", _MATCH + "select * from dp", _FX)
def q_duplicate_po(t: Tables):
    """C-5."""
    return rc.duplicate_po(fx.invoices(t)).select(*rc.RESULT_COLUMNS)


@query("duplicate_po_groups", _MATCH + """
select i.tenant_id, i.po_id, i.invoice_id, d.n_invoices
from invoices i join dup_keys d on d.tenant_id = i.tenant_id and d.po_id = i.po_id""", _FX)
def q_duplicate_po_groups(t: Tables):
    """C-5b / A-3: members of each duplicated PO with the group size (flat, not array_agg)."""
    return rc.duplicate_po_members(fx.invoices(t))


@query("flagged_ids", _MATCH + "select distinct tenant_id, invoice_id from results", _FX)
def q_flagged_ids(t: Tables):
    """U-1."""
    return rc.flagged_ids(results(t))


_STATUS = _MATCH + """
, status as (
  select i.tenant_id, i.invoice_id, i.supplier_id,
         case when f.invoice_id is not null then 'LEAKAGE_DETECTED' else 'APPROVED' end
           as reconciliation_status
  from invoices i left join (select distinct tenant_id, invoice_id from results) f
    on f.tenant_id = i.tenant_id and f.invoice_id = i.invoice_id)
"""


def status(t: Tables):
    return rc.invoice_status(fx.invoices(t), results(t))


@query("invoice_status", _STATUS + "select * from status", _FX)
def q_invoice_status(t: Tables):
    """C-6 / S-10."""
    return status(t)


@query("flagged_per_tenant", _STATUS + """
select t.tenant_id, t.name, cast(coalesce(c.n, 0) as bigint) as flagged_count
from tenants t left join (
  select tenant_id, count(*) as n from status
  where reconciliation_status = 'LEAKAGE_DETECTED' group by tenant_id) c
  on c.tenant_id = t.tenant_id""", _FX + ("tenants",))
def q_flagged_per_tenant(t: Tables):
    """C-8 / A-2."""
    return rc.flagged_per_tenant(status(t), fx.tenants(t))

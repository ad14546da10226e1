"""Report, scope and count queries (S-2, Q-1 .. Q-7, A-4 .. A-8)."""

from __future__ import annotations

from ..operators import reports as rp
from ..operators.scope import scope
from ..sources import fixtures as fx
from ..sources.tables import Tables
from .q_reconcile import _MATCH, _STATUS, results, status
from .registry import query

_FX = ("invoices", "contract_items", "suppliers")
SCOPE_TENANT = 2
SEARCH_TERM = "plier#00000001"


@query("tenant_scope", f"select * from invoices where tenant_id = {SCOPE_TENANT}", ("invoices",))
def q_tenant_scope(t: Tables):
    """S-2: one tenant's invoices (the scope predicate reaches the scan)."""
    return scope(fx.invoices(t), SCOPE_TENANT)


@query("tenant_scope_closed", "select * from invoices where false", ("invoices",))
def q_tenant_scope_closed(t: Tables):
    """S-2: no tenant set => no rows."""
    return scope(fx.invoices(t), None)


@query("flagged_invoices", _MATCH + """
, ranked as (
  select r.tenant_id, r.invoice_id as invoice_number, r.supplier_id, s.name as supplier_name,
         r.check_type, r.expected_value, r.actual_value, r.severity, r.detected_at,
         row_number() over (partition by r.tenant_id
                            order by r.detected_at desc nulls last, r.invoice_id asc,
                                     r.check_type asc, r.expected_value asc nulls first) as rn
  from results r join suppliers s on s.tenant_id = r.tenant_id and s.supplier_id = r.supplier_id)
select tenant_id, invoice_number, supplier_id, supplier_name, check_type, expected_value,
       actual_value, severity, detected_at
from ranked where rn <= 10""", _FX)
def q_flagged_invoices(t: Tables):
    """Q-1: newest 10 flagged rows per tenant (limit given as text)."""
    return rp.flagged_invoices(results(t), fx.suppliers(t), "10")


@query("flagged_report", _MATCH + """
select r.tenant_id, r.invoice_id as invoice_number, s.name as supplier_name, r.check_type,
       r.expected_value, r.actual_value, r.variance_amount, r.severity, r.detected_at,
       coalesce(cast(r.expected_value as varchar), '—') as expected_shown,
       coalesce(cast(r.actual_value as varchar), '—') as actual_shown
from results r join suppliers s on s.tenant_id = r.tenant_id and s.supplier_id = r.supplier_id""", _FX)
def q_flagged_report(t: Tables):
    """Q-2 / F-7: all result rows for the dashboard, severity as text order."""
    return rp.flagged_report(results(t), fx.suppliers(t))


@query("supplier_search", f"""
, first_hit as (
  select tenant_id, min(supplier_id) as supplier_id from suppliers
  where name ilike '%{SEARCH_TERM}%' group by tenant_id)
select s.tenant_id, s.supplier_id, s.name, s.category, s.risk_score,
       case when c.contract_number is null then 'none'
            else c.contract_number || ' (' || c.status || ')' end as contract_label
from suppliers s join first_hit f on f.tenant_id = s.tenant_id and f.supplier_id = s.supplier_id
left join contracts c on c.tenant_id = s.tenant_id and c.supplier_id = s.supplier_id""",
        ("suppliers", "contracts"))
def q_supplier_search(t: Tables):
    """Q-5 / F-2 / J-5: supplier profile by case-insensitive name search."""
    return rp.supplier_search(fx.suppliers(t), fx.contracts(t), SEARCH_TERM)


@query("tenant_list", "select tenant_id, name from tenants", ("tenants",))
def q_tenant_list(t: Tables):
    """Q-7: tenants ordered by name."""
    return rp.tenant_list(fx.tenants(t))


@query("supplier_list", "select tenant_id, supplier_id, name from suppliers", ("suppliers",))
def q_supplier_list(t: Tables):
    """Q-7: suppliers ordered by name within tenant."""
    return rp.supplier_list(fx.suppliers(t))


@query("tenant_table_counts", """
, po as (select distinct tenant_id, po_id from invoices where po_id is not null)
, tagged as (
  select tenant_id, 'suppliers' as tbl from suppliers
  union all select tenant_id, 'contracts' from contracts
  union all select tenant_id, 'contract_items' from contract_items
  union all select tenant_id, 'purchase_orders' from po
  union all select tenant_id, 'invoices' from invoices)
select tenant_id,
       count(*) filter (where tbl = 'suppliers') as n_suppliers,
       count(*) filter (where tbl = 'contracts') as n_contracts,
       count(*) filter (where tbl = 'contract_items') as n_contract_items,
       count(*) filter (where tbl = 'purchase_orders') as n_purchase_orders,
       count(*) filter (where tbl = 'invoices') as n_invoices
from tagged group by tenant_id""", ("suppliers", "contracts", "contract_items", "invoices"))
def q_tenant_table_counts(t: Tables):
    """A-4: per-tenant counts of five tables."""
    inv = fx.invoices(t)
    return rp.tenant_table_counts({
        "suppliers": fx.suppliers(t), "contracts": fx.contracts(t),
        "contract_items": fx.contract_items(t), "purchase_orders": rp.purchase_orders(inv),
        "invoices": inv})


@query("supplier_spend", """
, spend as (
  select tenant_id, supplier_id, cast(sum(total_amount) as decimal(38,5)) as total_spend
  from invoices group by tenant_id, supplier_id)
select tenant_id, supplier_id, total_spend from (
  select *, row_number() over (partition by tenant_id order by total_spend desc, supplier_id) as rn
  from spend) where rn <= 5""", ("invoices",))
def q_supplier_spend(t: Tables):
    """A-5: top 5 suppliers per tenant by invoiced amount."""
    return rp.supplier_spend(fx.invoices(t), 5)


@query("flagged_count", _STATUS + """
select tenant_id, count(*) as flagged_count from status
where reconciliation_status = 'LEAKAGE_DETECTED' group by tenant_id""", ("invoices", "contract_items"))
def q_flagged_count(t: Tables):
    """A-6."""
    return rp.flagged_count(status(t))


@query("variance_by_severity", _MATCH + """
select tenant_id, severity,
       round(cast(sum(variance_amount) as double) / nullif(count(variance_amount), 0), 4) as avg_variance,
       count(variance_amount) as n_with_variance
from results group by tenant_id, severity""", ("invoices", "contract_items"))
def q_variance_by_severity(t: Tables):
    """A-7."""
    return rp.variance_by_severity(results(t))


@query("supplier_count", "select tenant_id, count(*) as supplier_count from suppliers group by tenant_id",
       ("suppliers",))
def q_supplier_count(t: Tables):
    """A-8."""
    return rp.supplier_count(fx.suppliers(t))

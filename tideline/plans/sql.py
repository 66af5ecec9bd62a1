"""The logs of `tideline.sources.logs` as DuckDB SQL, for the oracles."""

LINES = """
lines AS (SELECT l_orderkey AS k, l_partkey AS part, l_returnflag AS rf, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS BIGINT) AS quantity, l_shipdate AS shipped,
  row_number() OVER w AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)),
counted AS (SELECT k, count(*) AS c FROM lines GROUP BY k)"""

ORDERS = (
    LINES
    + """,
raw AS (
  SELECT o_orderkey AS model_id, 'OrderCreated' AS event_type, 0::BIGINT AS event_number, o_orderdate AS created_on, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, NULL::BIGINT AS quantity, o_custkey AS customer_id, NULL::BIGINT AS part_id FROM orders
  UNION ALL SELECT k, 'LineAdded', n, shipped, price, quantity, NULL, part FROM lines JOIN orders ON o_orderkey = k
  UNION ALL SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'OrderConfirmed' ELSE 'OrderAbandoned' END, coalesce(c, 0) + 1, o_orderdate, NULL, NULL, NULL, NULL FROM orders LEFT JOIN counted ON k = o_orderkey WHERE o_orderstatus IN ('F', 'O')
  UNION ALL SELECT lines.k, 'RefundAppliedToOrder', c + 1 + r, shipped, price, NULL, NULL, part FROM lines JOIN counted USING (k) JOIN orders ON o_orderkey = k WHERE o_orderstatus = 'F' AND rf = 'R'),
olog AS (SELECT 'order-' || model_id AS stream_id, *, event_number * 1099511627776 + model_id AS global_position FROM raw)"""
)

USERS = """
ulog AS (SELECT 'user-' || user_id AS stream_id, user_id AS model_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event_number, event_id AS global_position, ts AS created_on, props AS payload, CAST(value AS DECIMAL(18,2)) AS amount FROM events)"""

FAULTY = (
    USERS
    + """,
flog AS (SELECT stream_id, model_id, CASE WHEN global_position % 29 = 0 THEN 'mystery' ELSE event_type END AS event_type, event_number, global_position * 2 + copy AS global_position, created_on,
  CASE WHEN global_position % 31 = 0 THEN '{bad' WHEN global_position % 37 = 0 THEN chr(65279) || payload ELSE payload END AS payload, amount
  FROM ulog, (SELECT unnest([0, 1]) AS copy) WHERE global_position % 23 <> 0 AND (copy = 0 OR global_position % 17 = 0))"""
)

#: The order read model.
ORDER_MODEL = f"""WITH {ORDERS}
SELECT model_id, max(event_number)::BIGINT AS event_number, max(global_position)::BIGINT AS global_position,
  arg_max(CASE event_type WHEN 'OrderCreated' THEN 0 WHEN 'OrderConfirmed' THEN 1 WHEN 'OrderAbandoned' THEN 3 END, event_number)::INTEGER AS status,
  max(CASE WHEN event_type = 'OrderCreated' THEN amount END)::DOUBLE AS amount, max(customer_id) AS customer_id,
  count_if(event_type = 'LineAdded')::BIGINT AS line_count, coalesce(sum(quantity), 0)::BIGINT AS total_quantity,
  coalesce(sum(CASE WHEN event_type = 'LineAdded' THEN amount END), 0)::DOUBLE AS gross, coalesce(sum(CASE WHEN event_type = 'RefundAppliedToOrder' THEN amount END), 0)::DOUBLE AS total_refunded,
  count_if(event_type = 'RefundAppliedToOrder')::BIGINT AS refund_count, arg_max(CASE WHEN event_type = 'LineAdded' THEN part_id END, event_number) AS last_part,
  max(CASE WHEN event_type = 'OrderCreated' THEN created_on END) AS created_on, max(CASE WHEN event_type IN ('OrderConfirmed', 'OrderAbandoned') THEN created_on END) AS completed_on
FROM olog GROUP BY model_id"""


def judged(log: str, check: str, initial: str | None = None, deletes: tuple[str, ...] = (), name: str = "judged") -> str:
    """Verdict CTEs over a log CTE."""
    inside = "TRUE" if initial is None else f"coalesce(global_position >= min(CASE WHEN event_type = '{initial}' THEN global_position END) OVER (PARTITION BY model_id), FALSE)"
    step = {
        "disabled": "'applied'",
        "monotonic": "CASE WHEN event_number > last THEN 'applied' ELSE 'stale' END",
        "consecutive": "CASE WHEN event_number <= last THEN 'stale' WHEN event_number = last + 1 THEN 'applied' ELSE 'gap' END",
    }[check]
    ends = ", ".join(f"'{d}'" for d in deletes)
    final = "CASE WHEN global_position > g AND v IN ('applied', 'stale', 'gap') THEN 'faulted' ELSE v END" if check == "consecutive" else "v"
    out = f"""
{name}_a AS (SELECT *, {inside} AS inside FROM {log}),
{name}_b AS (SELECT *, coalesce(max(CASE WHEN inside THEN event_number END) OVER (PARTITION BY model_id ORDER BY global_position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN NOT inside THEN 'state_not_found' ELSE {step} END AS v FROM {name}_b),
{name}_d AS (SELECT *, min(CASE WHEN v = 'gap' THEN global_position END) OVER (PARTITION BY model_id) AS g FROM {name}_c),
{name}_e AS (SELECT *, {final} AS verdict_1 FROM {name}_d)"""
    if deletes:
        out += f""",
{name}_f AS (SELECT *, min(CASE WHEN verdict_1 = 'applied' AND event_type IN ({ends}) THEN global_position END) OVER (PARTITION BY model_id) AS d FROM {name}_e),
{name} AS (SELECT *, CASE WHEN global_position > d THEN 'state_not_found' ELSE verdict_1 END AS verdict FROM {name}_f)"""
    else:
        out += f",\n{name} AS (SELECT *, verdict_1 AS verdict FROM {name}_e)"
    return out

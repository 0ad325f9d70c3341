"""Named queries over the programs of pointers and of classes (sources.event_pointers, part_classes), each
with its own SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import analyses as A
from .operators import edits, graphs, ir, nullness
from .operators import pointsto as P
from .operators.artefacts import Artefacts
from .queries import QUERIES, SQL, query
from .sources import event_pointers as X
from .sources import part_classes as C
from .sources.facts import proxy_ctes

#: Shared parts of the SQL: flow, what is reached, tests, and facts that tests make on edges.
FLOW = """xf AS (SELECT DISTINCT i.fn, i.b AS src, o.blk AS dst FROM xi i JOIN xo o ON o.inst = i.inst WHERE o.role IN ('true_bb', 'false_bb', 'default_bb', 'case', 'dest')
  UNION SELECT fn, b, CAST(-1 AS BIGINT) FROM xi WHERE op IN ('ret', 'unreachable'))"""
LIVE = "xlive AS (SELECT DISTINCT fn, CAST(0 AS BIGINT) AS b FROM xi UNION SELECT l.fn, f.dst FROM xlive l JOIN xf f ON f.fn = l.fn AND f.src = l.b)"
TESTS = """xt AS (SELECT i.fn, i.b, v.val AS v, CASE WHEN c.pred = 'eq' THEN t.blk ELSE f.blk END AS nb, CASE WHEN c.pred = 'eq' THEN f.blk ELSE t.blk END AS ob FROM xi i JOIN xo o ON o.inst = i.inst AND o.role = 'cond'
  JOIN xi c ON c.inst = o.val JOIN xo v ON v.inst = c.inst AND v.role = 'cmp1' JOIN xo t ON t.inst = i.inst AND t.role = 'true_bb' JOIN xo f ON f.inst = i.inst AND f.role = 'false_bb'),
xgen AS (SELECT fn, b AS src, nb AS dst, v, CAST(1 AS BIGINT) AS pol FROM xt WHERE nb <> ob UNION SELECT fn, b, ob, v, 0 FROM xt WHERE nb <> ob)"""
CALLS = "xc AS (SELECT i.inst, i.fn, i.b, i.ord, c.val AS callee, a.val AS arg FROM xi i JOIN xo c ON c.inst = i.inst AND c.role = 'callee' JOIN xo a ON a.inst = i.inst AND a.role = 'arg')"
#: xtold: what blocks themselves tell, as (fn, b, v, pol). A fact fails where a way there has nothing that tells it.
FACTS = """xall AS (SELECT DISTINCT fn, v, pol FROM xgen UNION SELECT DISTINCT fn, v, pol FROM xtold),
xno AS (SELECT fn, CAST(0 AS BIGINT) AS b, v, pol FROM xall UNION SELECT f.fn, f.dst, n.v, n.pol FROM xno n JOIN xf f ON f.fn = n.fn AND f.src = n.b
  WHERE NOT EXISTS (SELECT 1 FROM xgen g WHERE g.fn = f.fn AND g.src = f.src AND g.dst = f.dst AND g.v = n.v AND g.pol = n.pol) AND NOT EXISTS (SELECT 1 FROM xtold t WHERE t.fn = n.fn AND t.b = n.b AND t.v = n.v AND t.pol = n.pol)),
xfact AS (SELECT l.fn, l.b, a.v, a.pol FROM xlive l JOIN xall a ON a.fn = l.fn WHERE NOT EXISTS (SELECT 1 FROM xno n WHERE n.fn = l.fn AND n.b = l.b AND n.v = a.v AND n.pol = a.pol))"""
NOTHING_TOLD = "xtold AS (SELECT fn, b, v, pol FROM (SELECT fn, src AS b, v, pol FROM xgen) z WHERE 1 = 0)"
READ = "xr AS (SELECT i.inst, i.fn, i.b, o.val AS v FROM xi i JOIN xo o ON o.inst = i.inst AND o.role = 'address' WHERE i.op IN ('load', 'store'))"
_PARAM = f"fn - {X.FN} + {X.ARG}"
#: Functions that read through their parameter on every way to their end, and calls that rely on it.
ALWAYS = f"""xrb AS (SELECT DISTINCT fn, b FROM xr WHERE v = {_PARAM}),
xav AS (SELECT DISTINCT fn, CAST(0 AS BIGINT) AS b FROM xi UNION SELECT f.fn, f.dst FROM xav a JOIN xf f ON f.fn = a.fn AND f.src = a.b WHERE NOT EXISTS (SELECT 1 FROM xrb r WHERE r.fn = a.fn AND r.b = a.b)),
xalways AS (SELECT l.fn FROM xlive l WHERE l.b = -1 AND NOT EXISTS (SELECT 1 FROM xav a WHERE a.fn = l.fn AND a.b = -1)),
xcn AS (SELECT * FROM xc WHERE callee IN (SELECT fn FROM xalways)),
xtold AS (SELECT DISTINCT fn, b, arg AS v, CAST(0 AS BIGINT) AS pol FROM xcn)"""


def _with(*parts: str) -> str:
    return proxy_ctes(*X.CTES, *parts)


def _entries(program):
    return program.functions.where(f"NOT is_external AND (fn_id - {X.FN}) % 10 = 0").select(F.col("fn_id").alias("fn"))


def _direct(program):
    """No pointer holds a function here: every call names one."""
    return P.TypePointsTo.of(program).points_to()


# -- what a call tells: dataflow in an environment --------------------------------------------------
@query(f"{_with(FLOW, LIVE, TESTS, CALLS, READ, ALWAYS, FACTS)} SELECT fn, b AS block, v AS value, pol AS polarity FROM xfact WHERE b <> -1")
def ir_null_after_calls(p):
    program = X.facts(p)
    return nullness.null_facts_in(program, nullness.always_reads(program))[0]


@query(
    f"""{_with(FLOW, LIVE, TESTS, CALLS, READ, ALWAYS, FACTS)}, kn AS (SELECT c.fn, c.inst, c.arg, EXISTS (SELECT 1 FROM xfact f WHERE f.fn = c.fn AND f.b = c.b AND f.v = c.arg AND f.pol = 1) AS gone,
  EXISTS (SELECT 1 FROM xfact f WHERE f.fn = c.fn AND f.b = c.b AND f.v = c.arg AND f.pol = 0) OR EXISTS (SELECT 1 FROM xcn e WHERE e.fn = c.fn AND e.b = c.b AND e.arg = c.arg AND e.ord < c.ord) AS known
  FROM xcn c JOIN xlive l ON l.fn = c.fn AND l.b = c.b)
SELECT fn, inst AS call, arg AS argument, CASE WHEN gone THEN 'null' ELSE 'unknown' END AS how FROM kn WHERE gone OR NOT known"""
)
def ir_null_arguments(p):
    program = X.facts(p)
    return nullness.null_facts_in(program, nullness.always_reads(program))[1]


@query(f"{_with(FLOW, LIVE, TESTS, NOTHING_TOLD, FACTS)} SELECT i.fn, i.inst AS iid, f.v AS value, f.pol AS polarity FROM xi i JOIN xfact f ON f.fn = i.fn AND f.b = i.b")
def ir_null_at(p):
    program = X.facts(p)
    made = Artefacts.of(program)
    return A.at_instructions(made["null_facts"], made["body"]).select("fn", "iid", "value", "polarity")


# -- what functions need of their arguments ---------------------------------------------------------
@query(
    f"""{_with(FLOW, LIVE, TESTS, CALLS, READ, NOTHING_TOLD, FACTS)}, fk AS (SELECT DISTINCT fn, b, v FROM xfact),
nd AS (SELECT DISTINCT r.fn FROM xr r JOIN xlive l ON l.fn = r.fn AND l.b = r.b WHERE r.v = r.{_PARAM} AND NOT EXISTS (SELECT 1 FROM fk WHERE fk.fn = r.fn AND fk.b = r.b AND fk.v = r.v)
  UNION SELECT c.fn FROM nd n JOIN xc c ON c.callee = n.fn JOIN xlive l ON l.fn = c.fn AND l.b = c.b WHERE c.arg = c.{_PARAM} AND NOT EXISTS (SELECT 1 FROM fk WHERE fk.fn = c.fn AND fk.b = c.b AND fk.v = c.arg)),
used AS (SELECT fn, b, v FROM xr UNION SELECT fn, b, arg FROM xc WHERE callee IN (SELECT fn FROM nd))
SELECT fn, 'needs' AS kind, {_PARAM} AS value_id FROM nd UNION SELECT u.fn, 'error', u.v FROM used u JOIN xfact f ON f.fn = u.fn AND f.b = u.b AND f.v = u.v AND f.pol = 1"""
)
def ir_nullability(p):
    program = X.facts(p)
    return nullness.nullability(program, _direct(program))


# -- which values may be null, across functions -------------------------------------------------------
_GLOBAL = f"BETWEEN {X.GLOBAL} AND {X.GLOBAL + X.GLOBALS - 1}"
MAY = f"""xn AS (SELECT inst, fn, b, op, ty, LEAD(inst) OVER (PARTITION BY fn, b ORDER BY ord) AS nx, ROW_NUMBER() OVER (PARTITION BY fn, b ORDER BY ord) AS nth FROM xi),
xs AS (SELECT inst AS node, nx AS succ FROM xn WHERE nx IS NOT NULL UNION ALL SELECT t.inst, h.inst FROM xf f JOIN xn t ON t.fn = f.fn AND t.b = f.src AND t.nx IS NULL JOIN xn h ON h.fn = f.fn AND h.b = f.dst AND h.nth = 1),
xld AS (SELECT i.inst AS v, o.val AS la FROM xi i JOIN xo o ON o.inst = i.inst AND o.role = 'address' WHERE i.op = 'load'),
xinj AS (SELECT CAST({X.NULL} AS BIGINT) AS v UNION SELECT l.v FROM xld l JOIN xi t ON t.inst = l.v AND t.ty = {X.POINTER} JOIN xi a ON a.inst = l.la AND a.op IN ('load', 'getelementptr') UNION SELECT o.inst FROM xinj j JOIN xo o ON o.val = j.v AND o.role = 'incoming'),
xst AS (SELECT s.inst AS node, s.val AS sa, v.val AS sv FROM xo s JOIN xo v ON v.inst = s.inst AND v.role = 'value' WHERE s.role = 'address'),
xg AS (SELECT inst AS node, CAST(-1 AS BIGINT) AS d, inst AS d2 FROM xi WHERE op = 'alloca' UNION SELECT node, -1, sa FROM xst WHERE sv IN (SELECT v FROM xinj) UNION SELECT node, sv, sa FROM xst
  UNION SELECT s.node, l.la, s.sa FROM xst s JOIN xld l ON l.v = s.sv WHERE l.la <> s.sa),
xk AS (SELECT node, sa AS d FROM xst WHERE sa <> sv),
xrv AS (SELECT i.fn, i.inst AS exit_, o.val AS rv FROM xi i JOIN xo o ON o.inst = i.inst AND o.role = 'retval'),
xrs AS (SELECT exit_, rv AS d FROM xrv UNION SELECT r.exit_, l.la FROM xrv r JOIN xld l ON l.v = r.rv UNION SELECT r.exit_, o.val FROM xrv r JOIN xo o ON o.inst = r.rv AND o.role = 'incoming' UNION SELECT exit_, -1 FROM xrv WHERE rv IN (SELECT v FROM xinj)),
xps AS (SELECT inst AS node, callee AS fn, CAST(-1 AS BIGINT) AS d, CAST(-1 AS BIGINT) AS d2 FROM xc UNION SELECT inst, callee, -1, callee - {X.FN} + {X.ARG} FROM xc WHERE callee < {X.EXTERN} AND arg IN (SELECT v FROM xinj)
  UNION SELECT inst, callee, arg, callee - {X.FN} + {X.ARG} FROM xc WHERE callee < {X.EXTERN} UNION SELECT c.inst, c.callee, l.la, c.callee - {X.FN} + {X.ARG} FROM xc c JOIN xld l ON l.v = c.arg WHERE c.callee < {X.EXTERN}),
xen AS (SELECT fn, inst AS node FROM xn WHERE b = 0 AND nth = 1 UNION SELECT DISTINCT callee, callee FROM xc WHERE callee >= {X.EXTERN}),
xex AS (SELECT fn, inst AS node FROM xi WHERE op = 'ret' UNION SELECT DISTINCT callee, callee FROM xc WHERE callee >= {X.EXTERN}),
xbk AS (SELECT c.inst AS node, e.fn, e.node AS exit_, CAST(-1 AS BIGINT) AS d, CAST(-1 AS BIGINT) AS d2 FROM xc c JOIN xex e ON e.fn = c.callee UNION SELECT c.inst, e.fn, e.node, r.d, c.inst FROM xc c JOIN xex e ON e.fn = c.callee JOIN xrs r ON r.exit_ = e.node
  UNION SELECT inst, callee, callee, -1, inst FROM xc WHERE callee >= {X.EXTERN}),
f AS (SELECT CAST(0 AS BIGINT) AS tag, e.fn AS a, z.d AS b, e.node AS c, z.d AS d FROM xen e CROSS JOIN (SELECT CAST(-1 AS BIGINT) AS d UNION SELECT {X.GLOBAL} + 2 * x FROM range(0, {X.GLOBALS // 2}) r(x)) z WHERE e.fn < {X.EXTERN} AND (e.fn - {X.FN}) % 10 = 0
 UNION (SELECT 0, p.a, p.b, s.succ, p.d FROM recurring.f p JOIN xs s ON s.node = p.c WHERE p.tag = 0 AND p.c NOT IN (SELECT inst FROM xc) AND NOT EXISTS (SELECT 1 FROM xk WHERE xk.node = p.c AND xk.d = p.d)
  UNION SELECT 0, p.a, p.b, s.succ, g.d2 FROM recurring.f p JOIN xg g ON g.node = p.c AND g.d = p.d JOIN xs s ON s.node = p.c WHERE p.tag = 0
  UNION SELECT 0, p.a, p.b, -p.c, p.d FROM recurring.f p JOIN xc ON xc.inst = p.c WHERE p.tag = 0 AND NOT p.d {_GLOBAL}
  UNION SELECT 0, p.a, p.b, s.succ, p.d FROM recurring.f p JOIN xs s ON s.node = -p.c WHERE p.tag = 0 AND p.c < 0
  UNION SELECT 0, s.fn, s.d2, e.node, s.d2 FROM recurring.f p JOIN xps s ON s.node = p.c AND s.d = p.d JOIN xen e ON e.fn = s.fn WHERE p.tag = 0
  UNION SELECT 1, s.fn, s.d2, p.c, p.d FROM recurring.f p JOIN xps s ON s.node = p.c AND s.d = p.d WHERE p.tag = 0
  UNION SELECT 0, c.callee, p.d, e.node, p.d FROM recurring.f p JOIN xc c ON c.inst = p.c JOIN xen e ON e.fn = c.callee WHERE p.tag = 0 AND p.d {_GLOBAL}
  UNION SELECT 1, c.callee, p.d, p.c, p.d FROM recurring.f p JOIN xc c ON c.inst = p.c WHERE p.tag = 0 AND p.d {_GLOBAL}
  UNION SELECT 2, p.a, p.b, p.c, p.d FROM recurring.f p JOIN xex x ON x.node = p.c AND x.fn = p.a WHERE p.tag = 0
  UNION SELECT 3, 0, i.c, i.d, k.d2 FROM recurring.f i JOIN recurring.f e ON e.tag = 2 AND e.a = i.a AND e.b = i.b JOIN xbk k ON k.node = i.c AND k.fn = i.a AND k.exit_ = e.c AND k.d = e.d WHERE i.tag = 1
  UNION SELECT 3, 0, i.c, i.d, e.d FROM recurring.f i JOIN recurring.f e ON e.tag = 2 AND e.a = i.a AND e.b = i.b WHERE i.tag = 1 AND e.d {_GLOBAL}
  UNION SELECT 0, p.a, p.b, -p.c, s.d FROM recurring.f p JOIN recurring.f s ON s.tag = 3 AND s.b = p.c AND s.c = p.d WHERE p.tag = 0))"""


@query(f"{_with(FLOW, CALLS, MAY)} SELECT DISTINCT c AS node, d AS value_id FROM f WHERE tag = 0 AND d <> -1 AND c > 0 AND NOT c BETWEEN {X.EXTERN} AND {X.EXTERN + X.EXTERNS - 1}")
def ir_may_be_null(p):
    program = X.facts(p)
    return nullness.may_be_null(program, _direct(program), _entries(program))


# -- returned values and phi nodes --------------------------------------------------------------------
RETURNS = """xph AS (SELECT i.fn, i.inst AS phi, i.b AS at_, o.val, o.blk FROM xi i JOIN xo o ON o.inst = i.inst AND o.role = 'incoming'),
xret AS (SELECT i.fn, i.b, o.val FROM xi i JOIN xo o ON o.inst = i.inst AND o.role = 'retval')"""
POST = """xpl AS (SELECT DISTINCT fn, CAST(-1 AS BIGINT) AS b FROM xi UNION SELECT l.fn, f.src FROM xpl l JOIN xf f ON f.fn = l.fn AND f.dst = l.b),
xbl AS (SELECT DISTINCT fn, b FROM xi),
xpa AS (SELECT fn, b AS d, CAST(-1 AS BIGINT) AS b FROM xbl UNION SELECT a.fn, a.d, f.src FROM xpa a JOIN xf f ON f.fn = a.fn AND f.dst = a.b AND f.src <> a.d),
xpd AS (SELECT l.fn, l.b, d.b AS dom FROM xpl l JOIN xbl d ON d.fn = l.fn AND d.b <> l.b WHERE l.b <> -1 AND NOT EXISTS (SELECT 1 FROM xpa a WHERE a.fn = l.fn AND a.d = d.b AND a.b = l.b) AND EXISTS (SELECT 1 FROM xpl z WHERE z.fn = d.fn AND z.b = d.b))"""
VISIT = """vis AS (SELECT fn, b, val FROM xret UNION (SELECT v.fn, f.src, v.val FROM vis v JOIN xf f ON f.fn = v.fn AND f.dst = v.b JOIN xpd d ON d.fn = f.fn AND d.b = f.src AND d.dom = v.b WHERE NOT EXISTS (SELECT 1 FROM xph h WHERE h.phi = v.val)
  UNION SELECT v.fn, h.blk, h.val FROM vis v JOIN xph h ON h.phi = v.val JOIN xpd d ON d.fn = v.fn AND d.b = h.blk AND d.dom = v.b)),
lab AS (SELECT fn, b, val FROM vis WHERE val NOT IN (SELECT phi FROM xph)),
tried AS (SELECT v.fn, f.src AS b FROM lab v JOIN xf f ON f.fn = v.fn AND f.dst = v.b WHERE NOT EXISTS (SELECT 1 FROM xpd d WHERE d.fn = f.fn AND d.b = f.src AND d.dom = v.b)
  UNION SELECT v.fn, h.blk FROM vis v JOIN xph h ON h.phi = v.val WHERE NOT EXISTS (SELECT 1 FROM xpd d WHERE d.fn = v.fn AND d.b = h.blk AND d.dom = v.b))"""


@query(f"{_with(FLOW, RETURNS, POST, VISIT)} SELECT fn, b AS block, min(val) AS value FROM lab GROUP BY fn, b HAVING count(DISTINCT val) = 1")
def ir_block_returns(p):
    return Artefacts.of(X.facts(p))["returns"]


@query(f"{_with(FLOW, RETURNS, POST, VISIT)} SELECT fn, b AS block FROM tried WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.fn = tried.fn AND l.b = tried.b) UNION SELECT fn, b FROM lab GROUP BY fn, b HAVING count(DISTINCT val) > 1")
def ir_poisoned_blocks(p):
    return Artefacts.of(X.facts(p))["poisoned"]


@query(
    f"""{_with(FLOW, RETURNS)}, m AS (SELECT fn, b, val FROM xret UNION (SELECT m.fn, f.src, m.val FROM m JOIN xf f ON f.fn = m.fn AND f.dst = m.b WHERE NOT EXISTS (SELECT 1 FROM xph h WHERE h.phi = m.val AND h.at_ = m.b)
  UNION SELECT m.fn, h.blk, h.val FROM m JOIN xph h ON h.phi = m.val AND h.at_ = m.b)) SELECT fn, b AS block, val AS value FROM m"""
)
def ir_may_return(p):
    return Artefacts.of(X.facts(p))["may_return"]


# -- postdominators at instructions -------------------------------------------------------------------
IPDOM = """dep AS (SELECT fn, b, count(*) AS n FROM xpd GROUP BY fn, b), ipd AS (SELECT d.fn, d.b, max_by(d.dom, coalesce(x.n, 0)) AS up FROM xpd d LEFT JOIN dep x ON x.fn = d.fn AND x.b = d.dom GROUP BY d.fn, d.b),
xo2 AS (SELECT fn, inst, b, LEAD(inst) OVER (PARTITION BY fn, b ORDER BY ord) AS nx, ROW_NUMBER() OVER (PARTITION BY fn, b ORDER BY ord) AS nth FROM xi), seen AS (SELECT fn, b FROM ipd UNION SELECT fn, up FROM ipd)"""


@query(f"{_with(FLOW, POST, IPDOM)} SELECT i.fn, i.inst AS iid, i.nx AS ipdom FROM xo2 i JOIN seen s ON s.fn = i.fn AND s.b = i.b WHERE i.nx IS NOT NULL UNION ALL SELECT i.fn, i.inst, h.inst FROM xo2 i JOIN ipd d ON d.fn = i.fn AND d.b = i.b JOIN xo2 h ON h.fn = i.fn AND h.b = d.up AND h.nth = 1 WHERE i.nx IS NULL")
def ir_ipdom_inst(p):
    return Artefacts.of(X.facts(p))["ipdom_inst"].withColumnRenamed("idom", "ipdom")


# -- edits --------------------------------------------------------------------------------------------
#: Field loads are replaced by the argument, calls get a test before them and what they return is read from a slot instead.
_NEW = 10 * 10**9
EDITS = f"""rm AS (SELECT i.inst, i.fn - {X.FN} + {X.ARG} AS val FROM xi i JOIN xo o ON o.inst = i.inst AND o.role = 'address' WHERE i.op = 'load' AND o.val BETWEEN {X.FIELD} AND {X.PHI - 1}),
fr AS (SELECT i.inst FROM xi i JOIN xo o ON o.inst = i.inst AND o.role = 'address' WHERE i.op = 'load' AND i.ty = {X.POINTER} AND o.val BETWEEN {X.GLOBAL} AND {X.GLOBAL + X.GLOBALS - 1}),
st AS (SELECT inst AS old, val AS new FROM rm UNION ALL SELECT inst, {_NEW} + inst FROM fr)"""


def _edited(p):
    """Loads of fields go for the argument, loads of globals are replaced by loads of the first slot, and every call has a
    test of its argument before it."""
    program = X.facts(p)
    load = program.instructions.where("opcode = 'load'").join(program.operands.where("role = 'address'").select("inst_id", "value_id"), "inst_id")
    removals = load.where(f"value_id BETWEEN {X.FIELD} AND {X.PHI - 1}").select("inst_id", (F.col("fn_id") - X.FN + X.ARG).alias("value_id"))
    shared = load.where(f"type_id = {X.POINTER} AND value_id BETWEEN {X.GLOBAL} AND {X.GLOBAL + X.GLOBALS - 1}")
    calls = program.instructions.where("opcode = 'call'").join(program.operands.where("role = 'arg'").select("inst_id", "value_id"), "inst_id")
    new = (F.col("inst_id") + _NEW).alias("inst_id")
    none = F.lit(None)
    insertions = shared.select(new, F.col("inst_id").alias("target"), F.lit(edits.INSTEAD).alias("place"), F.lit("load").alias("opcode"), F.lit(X.POINTER).cast("long").alias("type_id"), none.cast("string").alias("pred"))
    insertions = insertions.unionByName(calls.select(new, F.col("inst_id").alias("target"), F.lit(edits.BEFORE).alias("place"), F.lit("icmp").alias("opcode"), F.lit(X.INT).cast("long").alias("type_id"), F.lit("eq").alias("pred")))
    op = lambda df, role, value: df.select(new, F.lit(role).alias("role"), F.lit(0).alias("pos"), value.cast("long").alias("value_id"), none.cast("long").alias("block_id"))
    operands = op(shared, "address", (F.col("fn_id") - X.FN) * 2 + X.SLOT).unionByName(op(calls, "cmp1", F.col("value_id"))).unionByName(op(calls, "cmp2", F.lit(X.NULL)))
    return edits.rewrite(program, removals, insertions, operands)[0]


@query(
    f"""{_with(EDITS)}, ni AS (SELECT inst, fn, b, op, ord * 2 AS o FROM xi WHERE inst NOT IN (SELECT inst FROM rm) AND inst NOT IN (SELECT inst FROM fr) UNION ALL SELECT {_NEW} + i.inst, i.fn, i.b, i.op, i.ord * 2 FROM xi i JOIN fr ON fr.inst = i.inst
  UNION ALL SELECT {_NEW} + inst, fn, b, 'icmp', ord * 2 - 1 FROM xi WHERE op = 'call') SELECT inst AS inst_id, op AS opcode, ROW_NUMBER() OVER (PARTITION BY fn, b ORDER BY o) - 1 AS nth FROM ni"""
)
def ir_edited_instructions(p):
    nth = F.row_number().over(Window.partitionBy("fn_id", "block_id").orderBy("ord")) - 1
    return _edited(p).instructions.select("inst_id", "opcode", nth.cast("long").alias("nth"))


@query(
    f"""{_with(EDITS)}, no AS (SELECT inst, role, pos, val, blk FROM xo WHERE inst NOT IN (SELECT inst FROM rm) AND inst NOT IN (SELECT inst FROM fr) UNION ALL SELECT {_NEW} + i.inst, 'address', 0, (i.fn - {X.FN}) * 2 + {X.SLOT}, NULL FROM xi i JOIN fr ON fr.inst = i.inst
  UNION ALL SELECT {_NEW} + i.inst, 'cmp1', 0, o.val, NULL FROM xi i JOIN xo o ON o.inst = i.inst AND o.role = 'arg' WHERE i.op = 'call' UNION ALL SELECT {_NEW} + inst, 'cmp2', 0, {X.NULL}, NULL FROM xi WHERE op = 'call')
SELECT o.inst AS inst_id, o.role, coalesce(st.new, o.val, -1) AS value_id, coalesce(o.blk, -1) AS block_id FROM no o LEFT JOIN st ON st.old = o.val"""
)
def ir_edited_operands(p):
    none = F.lit(-1).cast("long")
    return _edited(p).operands.select("inst_id", "role", F.coalesce("value_id", none).alias("value_id"), F.coalesce("block_id", none).alias("block_id"))


@query(
    f"""{_with()}, cf AS (SELECT fn, fn + {_NEW} AS cp FROM (SELECT DISTINCT fn FROM xi) z WHERE (fn - {X.FN}) % 5 = 0)
SELECT o.inst + 2 * CAST({_NEW} AS BIGINT) AS inst_id, o.role, CASE WHEN o.val IN (SELECT inst FROM xi) OR o.val BETWEEN {X.ARG} AND {X.GLOBAL - 1} THEN o.val + 2 * CAST({_NEW} AS BIGINT) ELSE coalesce(o.val, -1) END AS value_id, cf.cp AS fn_id
FROM xo o JOIN xi i ON i.inst = o.inst JOIN cf ON cf.fn = i.fn"""
)
def ir_copied_operands(p):
    program = X.facts(p)
    copies = program.functions.where(f"NOT is_external AND (fn_id - {X.FN}) % 5 = 0").select("fn_id", (F.col("fn_id") + _NEW).alias("copy_id"), F.lit(2 * _NEW).alias("shift"), F.concat("name", F.lit("_copy")).alias("name"))
    made, _ = edits.copy_functions(program, copies)
    return made.operands.join(made.instructions.where(f"fn_id >= {_NEW}").select("inst_id", "fn_id"), "inst_id").select("inst_id", "role", F.coalesce("value_id", F.lit(-1).cast("long")).alias("value_id"), "fn_id")


# -- graphs as text -----------------------------------------------------------------------------------
#: Instructions with their neighbours; lines of nodes and clusters.
TEXT = """xq AS (SELECT fn, inst, b, op, ord, LEAD(inst) OVER (PARTITION BY fn, b ORDER BY ord) AS nx, ROW_NUMBER() OVER (PARTITION BY fn, b ORDER BY ord) AS nth FROM xi),
nl AS (SELECT fn, '  ' || CAST(inst AS VARCHAR) || ' [label="' || op || '"];' AS line FROM xi),
cl AS (SELECT fn, '  subgraph cluster_' || CAST(fn AS VARCHAR) || '_' || CAST(b AS VARCHAR) || ' { label="b' || CAST(b AS VARCHAR) || '"; ' || string_agg(CAST(inst AS VARCHAR), '; ' ORDER BY ord) || '; }' AS line FROM xi GROUP BY fn, b)"""


def _line(src: str, dst: str, tail: str = "''") -> str:
    return f"'  ' || CAST({src} AS VARCHAR) || ' -> ' || CAST({dst} AS VARCHAR) || {tail} || ';'"


_TAIL = f"""CASE o.role WHEN 'true_bb' THEN ' [label="True",color="forestgreen"]' WHEN 'false_bb' THEN ' [label="False",color="crimson"]' WHEN 'case' THEN ' [label="== ' || CAST(o.val - {X.ZERO} AS VARCHAR) || '",color="deepskyblue"]' ELSE '' END"""


@query(
    f"""{_with(TEXT)} SELECT DISTINCT i.fn, {_line("i.inst", "h.inst", _TAIL)} AS line FROM xi i JOIN xo o ON o.inst = i.inst AND o.role IN ('true_bb', 'false_bb', 'default_bb', 'case', 'dest') JOIN xq h ON h.fn = i.fn AND h.b = o.blk AND h.nth = 1
UNION ALL SELECT fn, {_line("inst", "nx")} FROM xq WHERE nx IS NOT NULL UNION ALL SELECT * FROM nl UNION ALL SELECT * FROM cl"""
)
def ir_dot_cfg(p):
    return graphs.flow_text(X.facts(p))


@query(f"{_with(FLOW, POST, IPDOM, TEXT)} SELECT i.fn, {_line('i.inst', 'i.nx')} AS line FROM xo2 i JOIN seen s ON s.fn = i.fn AND s.b = i.b WHERE i.nx IS NOT NULL UNION ALL SELECT i.fn, {_line('i.inst', 'h.inst')} FROM xo2 i JOIN ipd d ON d.fn = i.fn AND d.b = i.b JOIN xo2 h ON h.fn = i.fn AND h.b = d.up AND h.nth = 1 WHERE i.nx IS NULL UNION ALL SELECT * FROM nl")
def ir_dot_postdominators(p):
    return graphs.dominator_text(X.facts(p), post=True)


@query(
    f"""{_with(FLOW, POST, TEXT)}, up AS (SELECT fn, b, dom FROM xpd UNION SELECT fn, b, b FROM xbl), cd AS (SELECT DISTINCT f.fn, u.dom AS b, f.src AS dep FROM xf f JOIN up u ON u.fn = f.fn AND u.b = f.dst
  WHERE NOT EXISTS (SELECT 1 FROM xpd d WHERE d.fn = f.fn AND d.b = f.src AND d.dom = u.dom))
SELECT i.fn, {_line("i.inst", "t.inst")} AS line FROM xi i JOIN cd ON cd.fn = i.fn AND cd.b = i.b JOIN xq t ON t.fn = cd.fn AND t.b = cd.dep AND t.nx IS NULL UNION ALL SELECT * FROM nl UNION ALL SELECT * FROM cl"""
)
def ir_dot_control(p):
    return graphs.control_text(X.facts(p))


_IC = lambda label, colour, style: f"""' [label="{label}",color="{colour}",style="{style}"]'"""


@query(
    f"""{_with(FLOW, CALLS, TEXT)}, rn AS (SELECT fn, b, inst, ord * 2 AS o, op FROM xi UNION ALL SELECT fn, b, -inst, ord * 2 + 1, 'return' FROM xi WHERE op = 'call'),
bl AS (SELECT fn, b, 'subgraph cluster_' || CAST(fn AS VARCHAR) || '_' || CAST(b AS VARCHAR) || ' {{ label="b' || CAST(b AS VARCHAR) || '"; ' || string_agg(CAST(inst AS VARCHAR), '; ' ORDER BY o) || '; }}' AS body FROM rn GROUP BY fn, b)
SELECT {_line("CASE WHEN op = 'call' THEN -inst ELSE inst END", "nx")} AS line FROM xq WHERE nx IS NOT NULL
UNION ALL SELECT {_line("t.inst", "h.inst")} FROM xf f JOIN xq t ON t.fn = f.fn AND t.b = f.src AND t.nx IS NULL JOIN xq h ON h.fn = f.fn AND h.b = f.dst AND h.nth = 1
UNION ALL SELECT {_line("inst", "-inst", _IC("skip", "forestgreen", "dotted"))} FROM xc
UNION ALL SELECT {_line("c.inst", "h.inst", _IC("call", "deepskyblue", "dashed"))} FROM xc c JOIN xq h ON h.fn = c.callee AND h.b = 0 AND h.nth = 1
UNION ALL SELECT {_line("e.inst", "-c.inst", _IC("return", "crimson", "dashed"))} FROM xc c JOIN xi e ON e.fn = c.callee AND e.op = 'ret'
UNION ALL SELECT {_line("inst", "callee", _IC("call", "deepskyblue", "dashed"))} FROM xc WHERE callee >= {X.EXTERN} UNION ALL SELECT {_line("callee", "-inst", _IC("return", "crimson", "dashed"))} FROM xc WHERE callee >= {X.EXTERN}
UNION ALL SELECT '  ' || CAST(inst AS VARCHAR) || ' [label="' || op || '"];' FROM rn UNION ALL SELECT '  ' || CAST({X.EXTERN} + x AS VARCHAR) || ' [label="external e' || CAST(x AS VARCHAR) || '"];' FROM range(0, {X.EXTERNS}) r(x)
UNION ALL SELECT '  subgraph cluster_' || CAST(fn AS VARCHAR) || ' {{ label="f' || CAST(fn - {X.FN} AS VARCHAR) || '"; ' || string_agg(body, ' ' ORDER BY b) || ' }}' FROM bl GROUP BY fn"""
)
def ir_dot_icfg(p):
    program = X.facts(p)
    return graphs.icfg_text(program, ir.function_nodes(program))


# -- classes ------------------------------------------------------------------------------------------
def ir_class_types(spark, sf_dir):
    return ir.class_types(C.facts(spark, sf_dir))


def ir_class_names(spark, sf_dir):
    program = C.facts(spark, sf_dir)
    return ir.names_to_types(program, ir.class_parents(program).select(F.col("parent").alias("class")).distinct())


def ir_virtual_calls(spark, sf_dir):
    return ir.virtual_calls(C.facts(spark, sf_dir))


QUERIES |= {"ir_class_types": ir_class_types, "ir_class_names": ir_class_names, "ir_virtual_calls": ir_virtual_calls}
PARTS = """pt AS (SELECT DISTINCT CAST(p_partkey AS BIGINT) AS p FROM part), pc AS (SELECT p, CASE WHEN p // 3 IN (SELECT p FROM pt) AND p // 3 <> p THEN p // 3 END AS parent FROM pt)"""
SQL |= {
    "ir_class_types": f"WITH {PARTS} SELECT {C.FN} + p * 16 + 8 AS fn, 'C' || CAST(p AS VARCHAR) AS class, {C.STRUCT} + p AS type_id, CAST(NULL AS VARCHAR) AS error FROM pc",
    "ir_class_names": f"WITH {PARTS} SELECT DISTINCT 'C' || CAST(parent AS VARCHAR) AS class, {C.STRUCT} + parent AS type_id, CAST(NULL AS VARCHAR) AS error FROM pc WHERE parent IS NOT NULL",
    "ir_virtual_calls": f"""WITH RECURSIVE {PARTS}, anc AS (SELECT p, p AS up FROM pc UNION ALL SELECT a.p, c.parent FROM anc a JOIN pc c ON c.p = a.up WHERE c.parent IS NOT NULL),
vt AS (SELECT p, CAST(s AS BIGINT) AS s, {C.FN} + 16 * (CASE WHEN p % (s + 2) <> 0 OR p < {C.SLOTS} OR parent IS NULL THEN p ELSE parent END) + s AS f FROM pc CROSS JOIN range(0, {C.SLOTS}) r(s))
SELECT DISTINCT {C.INST} + c.p * 16 + 4 AS inst_id, vt.f AS target, 'virtual' AS kind FROM pc c JOIN anc a ON a.up = c.p JOIN vt ON vt.p = a.p AND vt.s = c.p % {C.SLOTS} WHERE c.p % 7 = 0
UNION ALL SELECT {C.INST} + p * 16 + 5, {C.FN} + p * 16 + 8, 'direct' FROM pc WHERE p % 7 = 0""",
}

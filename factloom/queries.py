"""Named queries over the event program (sources.facts), each with the SQL that states it
independently. All computed columns are named; integers are longs on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dot
from .operators import analyses as A
from .operators import callgraph as C
from .operators import flow, ir
from .operators import pointsto as P
from .operators.artefacts import Artefacts
from .operators.icfg import icfg, program_icfg
from .operators.ifds import Problem
from .plans.fixpoint import closure
from .sources import event_facts as X
from .sources.facts import EventProgram, proxy_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(EventProgram.read(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Shared parts of the SQL.
FLOW = "flow AS (SELECT * FROM cfg UNION ALL SELECT * FROM cfg_exit)"
LIVE = "live AS (SELECT fn, CAST(0 AS BIGINT) AS block FROM fns UNION SELECT l.fn, c.dst FROM live l JOIN cfg c ON c.fn = l.fn AND c.src = l.block)"
AVOID = """avoid AS (SELECT k.fn, k.b AS d, CAST(0 AS BIGINT) AS b FROM blk k WHERE k.b <> 0
  UNION SELECT a.fn, a.d, c.dst FROM avoid a JOIN cfg c ON c.fn = a.fn AND c.src = a.b AND c.dst <> a.d)"""
DOM = """dom AS (SELECT l.fn, l.block, d.b AS dom FROM live l JOIN blk d ON d.fn = l.fn AND d.b <> l.block
  WHERE NOT EXISTS (SELECT 1 FROM avoid a WHERE a.fn = l.fn AND a.d = d.b AND a.b = l.block) AND EXISTS (SELECT 1 FROM live z WHERE z.fn = d.fn AND z.block = d.b))"""
PLIVE = "plive AS (SELECT fn, CAST(-1 AS BIGINT) AS block FROM fns UNION SELECT l.fn, c.src FROM plive l JOIN flow c ON c.fn = l.fn AND c.dst = l.block)"
PAVOID = """pavoid AS (SELECT k.fn, k.b AS d, CAST(-1 AS BIGINT) AS b FROM blk k
  UNION SELECT a.fn, a.d, c.src FROM pavoid a JOIN flow c ON c.fn = a.fn AND c.dst = a.b AND c.src <> a.d)"""
PDOM = """pdom AS (SELECT l.fn, l.block, d.b AS dom FROM plive l JOIN blk d ON d.fn = l.fn AND d.b <> l.block
  WHERE l.block <> -1 AND NOT EXISTS (SELECT 1 FROM pavoid a WHERE a.fn = l.fn AND a.d = d.b AND a.b = l.block) AND EXISTS (SELECT 1 FROM plive z WHERE z.fn = d.fn AND z.block = d.b))"""


def _blocks(p: EventProgram) -> DataFrame:
    return p.ins.withColumn("b", F.floor(F.col("ord") / 4))


def _nodes(p: EventProgram) -> DataFrame:
    return p.events.select(F.col("user_id").alias("fn")).distinct()


# -- control flow ---------------------------------------------------------------------------
@query(f"{proxy_ctes(FLOW)} SELECT fn, src, dst FROM flow")
def cfg_edges(p):
    return p.flow


@query(f"{proxy_ctes(FLOW)} SELECT fn, dst AS block, count(*) AS n, min(src) AS lo, max(src) AS hi FROM flow GROUP BY fn, dst")
def cfg_predecessors(p):
    return flow.predecessors(p.flow).select("fn", "block", F.size("preds").cast("long").alias("n"), F.array_min("preds").alias("lo"), F.array_max("preds").alias("hi"))


@query(f"{proxy_ctes(FLOW)} SELECT fn, src AS block, count(*) AS n, min(dst) AS lo, max(dst) AS hi FROM flow GROUP BY fn, src")
def cfg_successors(p):
    return flow.successors(p.flow).select("fn", "block", F.size("succs").cast("long").alias("n"), F.array_min("succs").alias("lo"), F.array_max("succs").alias("hi"))


INST = """i AS (SELECT fn, iid, ord, CAST(FLOOR(ord / 4.0) AS BIGINT) AS b, op, k FROM ins),
ie AS (SELECT a.iid AS src, z.iid AS dst FROM i a JOIN i z ON z.fn = a.fn AND z.b = a.b AND z.ord = a.ord + 1
  UNION ALL SELECT k.tid, coalesce(h.iid, -1) FROM flow f JOIN blk k ON k.fn = f.fn AND k.b = f.src LEFT JOIN i h ON h.fn = f.fn AND h.ord = f.dst * 4)"""


@query(f"{proxy_ctes(FLOW, INST)} SELECT src, dst FROM ie")
def inst_edges(p):
    return flow.instruction_edges(p.ins, p.flow)


@query(f"{proxy_ctes()} SELECT fn * 16 + k % 16 AS value_id, count(*) AS n_uses, min(iid) AS first_use, max(iid) AS last_use FROM ins GROUP BY 1")
def uses_of(p):
    u = A.uses_of(p.ins.select(F.expr("fn * 16 + k % 16").alias("value_id"), F.col("iid").alias("inst_id")))
    return u.select("value_id", F.size("users").cast("long").alias("n_uses"), F.array_min("users").alias("first_use"), F.array_max("users").alias("last_use"))


@query(f"{proxy_ctes()} SELECT f.fn * 16 + 3 AS value_id, count(i.iid) AS n_uses FROM fns f LEFT JOIN ins i ON i.fn * 16 + i.k % 16 = f.fn * 16 + 3 GROUP BY 1")
def used_by(p):
    u = A.uses_of(p.ins.select(F.expr("fn * 16 + k % 16").alias("value_id"), F.col("iid").alias("inst_id")))
    return A.used_by(_nodes(p).select((F.col("fn") * 16 + 3).alias("value_id")), u).select("value_id", F.size("users").cast("long").alias("n_uses"))


@query(f"{proxy_ctes('r AS (SELECT fn, src, dst FROM cfg UNION SELECT r.fn, r.src, c.dst FROM r JOIN cfg c ON c.fn = r.fn AND c.src = r.dst)')} SELECT fn, src, dst FROM r")
def reach_cfg(p):
    return flow.reach(p.cfg)


@query(f"{proxy_ctes(LIVE)} SELECT k.fn, k.b AS block FROM blk k WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.fn = k.fn AND l.block = k.b)")
def unreachable_blocks(p):
    return p.blk.select("fn", F.col("b").alias("block")).join(flow.reachable_from_entry(p.flow), ["fn", "block"], "left_anti")


@query(f"{proxy_ctes(LIVE, AVOID, DOM)} SELECT fn, block, dom FROM dom")
def dominators(p):
    return flow.dominators(p.cfg).select("fn", "block", "dom")


@query(
    f"{proxy_ctes(LIVE, AVOID, DOM)}, dep AS (SELECT fn, block, count(*) AS n FROM dom GROUP BY fn, block) "
    "SELECT d.fn, d.block, max_by(d.dom, coalesce(x.n, 0)) AS idom FROM dom d LEFT JOIN dep x ON x.fn = d.fn AND x.block = d.dom GROUP BY d.fn, d.block"
)
def idom(p):
    return flow.immediate_dominators(p.cfg)


@query(
    f"{proxy_ctes(LIVE, AVOID, DOM)} SELECT c.fn, c.src AS a, c.dst AS b, (c.src = c.dst OR EXISTS (SELECT 1 FROM dom d WHERE d.fn = c.fn AND d.dom = c.src AND d.block = c.dst)) AS dominates FROM cfg c"
)
def dominates(p):
    return flow.dominates(p.cfg, p.cfg.select("fn", F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"{proxy_ctes(FLOW, PLIVE, PAVOID, PDOM)} SELECT fn, block, dom FROM pdom")
def postdominators(p):
    return flow.dominators(p.flow, post=True).select("fn", "block", "dom")


@query(
    f"{proxy_ctes(FLOW, PLIVE, PAVOID, PDOM)}, dep AS (SELECT fn, block, count(*) AS n FROM pdom GROUP BY fn, block) "
    "SELECT d.fn, d.block, max_by(d.dom, coalesce(x.n, 0)) AS ipdom FROM pdom d LEFT JOIN dep x ON x.fn = d.fn AND x.block = d.dom GROUP BY d.fn, d.block"
)
def ipdom(p):
    return flow.immediate_postdominators(p.flow)


CDG = """up AS (SELECT fn, block, dom FROM pdom UNION ALL SELECT fn, b, b FROM blk),
cdg AS (SELECT DISTINCT f.fn, u.dom AS block, f.src AS dep FROM flow f JOIN up u ON u.fn = f.fn AND u.block = f.dst
  WHERE NOT EXISTS (SELECT 1 FROM pdom d WHERE d.fn = f.fn AND d.block = f.src AND d.dom = u.dom))"""


@query(f"{proxy_ctes(FLOW, PLIVE, PAVOID, PDOM, CDG)} SELECT fn, block, dep FROM cdg")
def cdg_direct(p):
    return flow.control_dependences(p.flow)


@query(f"{proxy_ctes(FLOW, PLIVE, PAVOID, PDOM, CDG, 't AS (SELECT * FROM cdg UNION SELECT t.fn, t.block, c.dep FROM t JOIN cdg c ON c.fn = t.fn AND c.block = t.dep)')} SELECT fn, block, dep FROM t")
def cdg_transitive(p):
    return flow.control_dependences(p.flow, transitive=True)


@query(
    f"{proxy_ctes(LIVE)} SELECT f.fn, NOT EXISTS (SELECT 1 FROM live l JOIN blk k ON k.fn = l.fn AND k.b = l.block WHERE l.fn = f.fn AND k.term = 'purchase') AS noreturn FROM fns f"
)
def noreturn(p):
    return A.no_return(p.flow, p.blk.where("term = 'purchase'").select("fn", F.col("b").alias("block")), _nodes(p))


# -- call graph -----------------------------------------------------------------------------
@query(f"{proxy_ctes()} SELECT src, dst, 'direct' AS kind FROM cg")
def callgraph_edges(p):
    return p.calls.withColumn("kind", F.lit("direct"))


@query(f"{proxy_ctes()} SELECT src AS fn, dst AS callee FROM cg")
def callees(p):
    return C.callees(p.calls)


@query(f"{proxy_ctes()} SELECT dst AS fn, src AS caller FROM cg")
def callers(p):
    return C.callers(p.calls)


RC = "rc AS (SELECT fn AS src, fn AS dst FROM fns UNION SELECT rc.src, cg.dst FROM rc JOIN cg ON cg.src = rc.dst)"


@query(f"{proxy_ctes(RC)} SELECT src AS fn, dst AS callee FROM rc")
def all_callees(p):
    return C.reflexive_closure(p.calls, _nodes(p)).select(F.col("src").alias("fn"), F.col("dst").alias("callee"))


@query(f"{proxy_ctes(RC)} SELECT dst AS fn, src AS caller FROM rc")
def all_callers(p):
    back = p.calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return C.reflexive_closure(back, _nodes(p)).select(F.col("src").alias("fn"), F.col("dst").alias("caller"))


CG4 = "cg4 AS (SELECT DISTINCT i.fn AS src, (i.fn * 7 + i.iid) % n.n AS dst FROM ins i CROSS JOIN (SELECT MAX(user_id) + 1 AS n FROM events) n WHERE i.op = 'signup' AND i.k % 4 = 0)"
RC4 = "rc4 AS (SELECT fn AS src, fn AS dst FROM fns UNION SELECT rc4.src, cg4.dst FROM rc4 JOIN cg4 ON cg4.src = rc4.dst)"
SCC4 = "scc4 AS (SELECT a.src AS fn, min(a.dst) AS scc FROM rc4 a JOIN rc4 b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src)"
SCC = "sc AS (SELECT a.src AS fn, min(a.dst) AS scc FROM rc a JOIN rc b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src)"


def _calls4(p: EventProgram) -> DataFrame:
    n = p.events.agg((F.max("user_id") + 1).alias("n"))
    return p.ins.where("op = 'signup' AND k % 4 = 0").join(F.broadcast(n)).select(F.col("fn").alias("src"), F.expr("(fn * 7 + iid) % n").alias("dst")).distinct()


@query(f"{proxy_ctes(CG4, RC4, SCC4)} SELECT fn, scc FROM scc4")
def scc(p):
    return C.scc(_calls4(p), _nodes(p))


@query(f"{proxy_ctes(RC, SCC)} SELECT DISTINCT a.scc AS src, b.scc AS dst FROM cg JOIN sc a ON a.fn = cg.src JOIN sc b ON b.fn = cg.dst WHERE a.scc <> b.scc")
def condensed_edges(p):
    return C.condense(p.calls, C.scc(p.calls, _nodes(p)))


LEVEL = """ce AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM cg JOIN sc a ON a.fn = cg.src JOIN sc b ON b.fn = cg.dst WHERE a.scc <> b.scc),
lv AS (SELECT DISTINCT scc, CAST(0 AS BIGINT) AS level FROM sc UNION SELECT ce.src, lv.level + 1 FROM lv JOIN ce ON ce.dst = lv.scc)"""


@query(f"{proxy_ctes(RC, SCC, LEVEL)} SELECT scc, max(level) AS level FROM lv GROUP BY scc")
def topo_level(p):
    comp = C.scc(p.calls, _nodes(p))
    return C.levels(C.condense(p.calls, comp), comp)


@query(f"{proxy_ctes(RC)} SELECT rc.src AS fn, max(i.k) AS best FROM rc JOIN ins i ON i.fn = rc.dst GROUP BY rc.src")
def bottomup_summary(p):
    return C.reaching_maximum(p.calls, p.ins.select("fn", F.col("k").alias("value")))


def _op_steps() -> list[C.Step]:
    """Components by the parities their functions and callees have, then whether both occur."""
    return [
        C.Step("parity", lambda fns, now, earlier: {str(f % 2) for f in fns}),
        C.Step("mixed", lambda fns, now, earlier: {"yes"} if len(earlier["parity"]) == 2 else set(), ("parity",)),
    ]


@query(
    f"{proxy_ctes(RC, SCC)}, par AS (SELECT DISTINCT sc.scc, CAST(rc.dst % 2 AS VARCHAR) AS summary FROM sc JOIN rc ON rc.src = sc.fn) "
    "SELECT scc, 'parity' AS step, summary FROM par UNION ALL SELECT scc, 'mixed', 'yes' FROM par GROUP BY scc HAVING count(*) = 2"
)
def composed_summaries(p):
    return C.bottom_up(p.calls, _nodes(p), _op_steps())


# -- points-to ------------------------------------------------------------------------------
OPS = "CASE CAST(k % 5 AS INT) WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END"


@query(f"{proxy_ctes()} SELECT i.iid AS value_id, f.fn AS target FROM ins i JOIN ins f ON f.ord = 0 AND f.op = {OPS.replace('k %', 'i.k %')} WHERE i.op = 'signup' AND i.k % 16 = 0")
def trivial_points_to(p):
    fns = p.ins.where("ord = 0").select(F.col("fn").alias("fn_id"), F.col("op").alias("type_id"))
    vals = p.ins.where("op = 'signup' AND k % 16 = 0").select(F.col("iid").alias("value_id"), F.lit("signup").alias("type_id"), F.expr(OPS).alias("pointee_type_id"))
    # A function's own entry belongs to the whole relation but shares ids with instructions here.
    return P.TypePointsTo(vals, fns).by_type()


AND = """x AS (SELECT fn, op, k, iid, fn * 8 + k % 8 AS a, fn * 8 + iid % 8 AS b FROM ins),
addr_ AS (SELECT DISTINCT a AS x, b AS l FROM x WHERE op = 'view' AND k % 4 = 0),
copy_ AS (SELECT DISTINCT a AS x, b AS y FROM x WHERE op = 'click' AND k % 3 = 0 UNION SELECT cg.dst * 8, cg.src * 8 + 1 FROM cg),
load_ AS (SELECT DISTINCT a AS x, b AS y FROM x WHERE op = 'purchase' AND k % 3 = 0),
store_ AS (SELECT DISTINCT a AS x, b AS y FROM x WHERE op = 'error' AND k % 3 = 0)"""


@query(
    proxy_ctes(
        AND,
        """pts AS (SELECT x, l FROM addr_ UNION (SELECT c.x, p.l FROM copy_ c JOIN recurring.pts p ON p.x = c.y
  UNION SELECT d.x, h.l FROM load_ d JOIN recurring.pts m ON m.x = d.y JOIN recurring.pts h ON h.x = m.l + 1152921504606846976
  UNION SELECT m.l + 1152921504606846976, v.l FROM store_ s JOIN recurring.pts m ON m.x = s.x JOIN recurring.pts v ON v.x = s.y))""",
    )
    + " SELECT x, l FROM pts"
)
def andersen(p):
    x = p.ins.select("op", "k", F.expr("fn * 8 + k % 8").alias("a"), F.expr("fn * 8 + iid % 8").alias("b"))
    pick = lambda cond, second: x.where(cond).select(F.col("a").alias("x"), F.col("b").alias(second)).distinct()
    calls = p.calls.select((F.col("dst") * 8).alias("x"), (F.col("src") * 8 + 1).alias("y"))
    return P.andersen(pick("op = 'view' AND k % 4 = 0", "l"), pick("op = 'click' AND k % 3 = 0", "y").unionByName(calls).distinct(), pick("op = 'purchase' AND k % 3 = 0", "y"), pick("op = 'error' AND k % 3 = 0", "y"))


# -- dataflow -------------------------------------------------------------------------------
NULLS = """vs AS (SELECT CAST(v AS BIGINT) AS v, CAST(pol AS BIGINT) AS pol FROM range(0, 8) t(v), range(0, 2) s(pol)),
tst AS (SELECT k.fn, k.b, k.tid % 8 AS v, LEAST(k.b + 2 + k.tid % 3, f.mb) AS nb, k.b + 1 AS ob FROM blk k JOIN fns f ON f.fn = k.fn WHERE k.term = 'click' AND k.tid % 2 = 0 AND k.b < f.mb),
gen AS (SELECT fn, b AS src, nb AS dst, v, CAST(1 AS BIGINT) AS pol FROM tst WHERE nb <> ob UNION ALL SELECT fn, b, ob, v, CAST(0 AS BIGINT) FROM tst WHERE nb <> ob),
nofact AS (SELECT f.fn, CAST(0 AS BIGINT) AS b, v, pol FROM fns f CROSS JOIN vs
  UNION SELECT n.fn, c.dst, n.v, n.pol FROM nofact n JOIN cfg c ON c.fn = n.fn AND c.src = n.b
  WHERE NOT EXISTS (SELECT 1 FROM gen g WHERE g.fn = c.fn AND g.src = c.src AND g.dst = c.dst AND g.v = n.v AND g.pol = n.pol))"""


@query(
    f"{proxy_ctes(LIVE, NULLS)} SELECT l.fn, l.block, vs.v AS value, vs.pol AS polarity FROM live l CROSS JOIN vs "
    "WHERE NOT EXISTS (SELECT 1 FROM nofact n WHERE n.fn = l.fn AND n.b = l.block AND n.v = vs.v AND n.pol = vs.pol)"
)
def null_facts_at_block(p):
    b = p.blk.withColumn("mb", F.max("b").over(Window.partitionBy("fn")))
    is_test = F.expr("term = 'click' AND tid % 2 = 0 AND b < mb")
    tests = b.select("fn", "b", F.when(is_test, F.col("tid") % 8).alias("value"), F.expr("least(b + 2 + tid % 3, mb)").alias("null_block"), (F.col("b") + 1).alias("other_block"))
    return A.null_facts(p.flow, tests)


@query(
    f"{proxy_ctes(FLOW, PLIVE, PAVOID, PDOM)}, lab AS (SELECT fn, b AS block, tid % 16 AS value FROM blk WHERE term = 'purchase' "
    "UNION SELECT c.fn, c.src, l.value FROM lab l JOIN flow c ON c.fn = l.fn AND c.dst = l.block JOIN pdom d ON d.fn = c.fn AND d.block = c.src AND d.dom = l.block) SELECT fn, block, value FROM lab"
)
def block_return(p):
    ret = p.blk.where("term = 'purchase'").select("fn", F.col("b").alias("block"), (F.col("tid") % 16).alias("value"))
    return A.block_returns(p.flow, ret)[0]


EFFECT = "CASE WHEN op = 'view' AND k % 8 = 0 THEN 1 WHEN op = 'view' AND k % 8 = 1 THEN -1 END"
EFF = f"""e AS (SELECT fn, CAST(FLOOR(ord / 4.0) AS BIGINT) AS b, ord, iid % 4 AS arg, {EFFECT} AS eff FROM ins),
le AS (SELECT fn, b, arg, max_by(eff, ord) AS eff FROM e WHERE eff IS NOT NULL GROUP BY fn, b, arg),
ua AS (SELECT CAST(a AS BIGINT) AS arg, CAST(s AS BIGINT) AS eff FROM range(0, 4) t(a), (VALUES (1), (-1)) z(s)),
noeff AS (SELECT f.fn, CAST(0 AS BIGINT) AS b, arg, eff FROM fns f CROSS JOIN ua
  UNION SELECT c.fn, c.dst, le.arg, -le.eff FROM flow c JOIN live l ON l.fn = c.fn AND l.block = c.src JOIN le ON le.fn = c.fn AND le.b = c.src
  UNION SELECT c.fn, c.dst, n.arg, n.eff FROM noeff n JOIN flow c ON c.fn = n.fn AND c.src = n.b WHERE NOT EXISTS (SELECT 1 FROM le WHERE le.fn = c.fn AND le.b = c.src AND le.arg = n.arg))"""


@query(
    f"{proxy_ctes(FLOW, LIVE, EFF)} SELECT DISTINCT c.fn, ua.arg, ua.eff AS effect FROM cfg_exit c JOIN live l ON l.fn = c.fn AND l.block = c.src CROSS JOIN ua "
    "WHERE NOT EXISTS (SELECT 1 FROM noeff n WHERE n.fn = c.fn AND n.b = -1 AND n.arg = ua.arg AND n.eff = ua.eff)"
)
def scalar_effects(p):
    return A.scalar_effects(p.flow, _blocks(p).select("fn", "b", "ord", (F.col("iid") % 4).alias("arg"), F.expr(EFFECT).alias("effect")))


DEFS = """i AS (SELECT fn, iid, ord, CAST(FLOOR(ord / 4.0) AS BIGINT) AS b, CASE WHEN op IN ('signup', 'purchase') THEN k % 8 END AS dv, CASE WHEN op NOT IN ('signup', 'purchase') THEN k % 8 END AS uv FROM ins),
kill AS (SELECT DISTINCT fn, b, dv AS v FROM i WHERE dv IS NOT NULL)"""


def _defs(p: EventProgram) -> DataFrame:
    d = F.expr("op IN ('signup', 'purchase')")
    return _blocks(p).select("fn", "b", "ord", "iid", F.when(d, F.col("k") % 8).alias("def_var"), F.when(~d, F.col("k") % 8).alias("use_var"))


@query(
    f"{proxy_ctes(FLOW, PLIVE, DEFS)}, lv AS (SELECT DISTINCT u.fn, u.b AS block, u.uv AS var FROM i u JOIN plive r ON r.fn = u.fn AND r.block = u.b WHERE u.uv IS NOT NULL "
    "AND NOT EXISTS (SELECT 1 FROM i d WHERE d.fn = u.fn AND d.b = u.b AND d.ord < u.ord AND d.dv = u.uv) "
    "UNION SELECT c.fn, c.src, l.var FROM lv l JOIN cfg c ON c.fn = l.fn AND c.dst = l.block WHERE NOT EXISTS (SELECT 1 FROM kill z WHERE z.fn = c.fn AND z.b = c.src AND z.v = l.var)) SELECT fn, block, var FROM lv"
)
def liveness(p):
    return A.liveness(p.flow, _defs(p))


RDEF = """last_ AS (SELECT fn, b, dv AS v, max_by(iid, ord) AS d FROM i WHERE dv IS NOT NULL GROUP BY fn, b, dv),
rd AS (SELECT c.fn, c.dst AS block, x.v AS var, x.d AS def_iid FROM cfg c JOIN live l ON l.fn = c.fn AND l.block = c.src JOIN last_ x ON x.fn = c.fn AND x.b = c.src
  UNION SELECT c.fn, c.dst, r.var, r.def_iid FROM rd r JOIN cfg c ON c.fn = r.fn AND c.src = r.block WHERE NOT EXISTS (SELECT 1 FROM kill z WHERE z.fn = c.fn AND z.b = c.src AND z.v = r.var))"""


@query(f"{proxy_ctes(LIVE, DEFS, RDEF)} SELECT fn, block, var, def_iid FROM rd")
def reaching_defs(p):
    return A.reaching_definitions(p.flow, _defs(p))


@query(
    f"""{proxy_ctes(LIVE, DEFS, RDEF)}, near AS (SELECT a.iid, count(DISTINCT d.dv) AS n FROM i a JOIN i d ON d.fn = a.fn AND d.b = a.b AND d.ord <= a.ord AND d.dv IS NOT NULL GROUP BY a.iid),
far AS (SELECT a.iid, count(*) AS n FROM i a JOIN rd r ON r.fn = a.fn AND r.block = a.b WHERE NOT EXISTS (SELECT 1 FROM i d WHERE d.fn = a.fn AND d.b = a.b AND d.ord <= a.ord AND d.dv = r.var) GROUP BY a.iid)
SELECT i.fn, i.iid, CASE WHEN l.fn IS NULL THEN 0 ELSE coalesce(near.n, 0) + coalesce(far.n, 0) END AS n_defs FROM i LEFT JOIN live l ON l.fn = i.fn AND l.block = i.b LEFT JOIN near ON near.iid = i.iid LEFT JOIN far ON far.iid = i.iid"""
)
def dataflow_at(p):
    return A.reaching_definitions_at(p.flow, _defs(p))


# -- access paths and classes ------------------------------------------------------------------
COMP = "CASE op WHEN 'view' THEN 'Deref' WHEN 'click' THEN concat('Field', CAST(k % 4 AS {s})) WHEN 'error' THEN 'Array' WHEN 'signup' THEN 'Union' END"


@query(
    f"""{proxy_ctes()}, i AS (SELECT fn, iid, ord, op, {COMP.format(s="VARCHAR")} AS comp, CASE WHEN op <> 'purchase' AND ord % 4 <> 0 THEN lag(iid) OVER (PARTITION BY fn ORDER BY ord) END AS base FROM ins),
w AS (SELECT fn, iid, iid AS root, 'Deref' AS path, CAST(1 AS BIGINT) AS n FROM i WHERE base IS NULL UNION ALL SELECT i.fn, i.iid, w.root, w.path || '.' || i.comp, w.n + 1 FROM w JOIN i ON i.base = w.iid)
SELECT fn, iid, root, path, n FROM w"""
)
def access_path(p):
    base = F.when(F.expr("op <> 'purchase' AND ord % 4 <> 0"), F.lag("iid").over(Window.partitionBy("fn").orderBy("ord")))
    return A.access_paths(p.ins.select("fn", "iid", base.alias("base"), F.expr(COMP.format(s="STRING")).alias("comp")))


PARTS = "pc AS (SELECT CAST(p_partkey AS BIGINT) AS class, CAST(FLOOR(p_partkey / 3.0) AS BIGINT) AS parent FROM part)"
PE = "pe AS (SELECT c.parent, c.class AS child FROM pc c JOIN pc q ON q.class = c.parent AND c.parent <> c.class)"
ANC = "anc AS (SELECT class, class AS ancestor FROM pc UNION ALL SELECT a.class, e.parent FROM anc a JOIN pe e ON e.child = a.ancestor)"


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("class"), F.floor(F.col("p_partkey") / 3.0).alias("parent"))
    e = c.join(c.select(F.col("class").alias("q")), F.col("parent") == F.col("q")).where("parent <> class").select("parent", F.col("class").alias("child"))
    return c.select("class"), e


def class_children(spark, sf_dir):
    return _classes(spark, sf_dir)[1].groupBy("parent").agg(F.count("*").alias("n"), F.min("child").alias("lo"), F.max("child").alias("hi"))


def class_ancestors(spark, sf_dir):
    classes, edges = _classes(spark, sf_dir)
    return A.class_ancestors(edges, classes)


def vcall_targets(spark, sf_dir):
    classes, edges = _classes(spark, sf_dir)
    slots = classes.select("class", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("slot"))
    own = slots.select("class", "slot", F.expr("CASE WHEN class % (slot + 2) <> 0 THEN class * 10 + slot ELSE (class div 3) * 10 + slot END").alias("fn"))
    calls = classes.where("class % 7 = 0").select(F.col("class").alias("site"), "class", (F.col("class") % 3).alias("slot"))
    return A.virtual_targets(calls, A.class_ancestors(edges, classes), own)


QUERIES |= {"class_children": class_children, "class_ancestors": class_ancestors, "vcall_targets": vcall_targets}
SQL |= {
    "class_children": f"WITH {PARTS}, {PE} SELECT parent, count(*) AS n, min(child) AS lo, max(child) AS hi FROM pe GROUP BY parent",
    "class_ancestors": f"WITH RECURSIVE {PARTS}, {PE}, {ANC} SELECT class, ancestor FROM anc",
    "vcall_targets": f"""WITH RECURSIVE {PARTS}, {PE}, {ANC}, vt AS (SELECT class, CAST(s AS BIGINT) AS slot,
  CASE WHEN class % (s + 2) <> 0 THEN class * 10 + s ELSE (class // 3) * 10 + s END AS fn FROM pc CROSS JOIN range(0, 3) t(s))
SELECT DISTINCT c.class AS site, vt.fn AS target FROM pc c JOIN anc a ON a.ancestor = c.class JOIN vt ON vt.class = a.class AND vt.slot = c.class % 3 WHERE c.class % 7 = 0""",
}

# -- interprocedural -----------------------------------------------------------------------------
SITES = "site AS (SELECT i.iid AS node, i.fn AS src, (i.fn * 7 + i.iid) % n.n AS fn, i.k FROM ins i CROSS JOIN (SELECT MAX(user_id) + 1 AS n FROM events) n WHERE i.op = 'signup' AND i.k % 16 = 0)"


def _sites(p: EventProgram) -> DataFrame:
    n = p.events.agg((F.max("user_id") + 1).alias("n"))
    return p.ins.where("op = 'signup' AND k % 16 = 0").join(F.broadcast(n)).select(F.col("iid").alias("node"), F.col("fn").alias("src"), F.expr("(fn * 7 + iid) % n").alias("fn"), "k")


ICFG = """entry_ AS (SELECT fn, iid AS node FROM ins WHERE ord = 0),
exits AS (SELECT fn, tid AS node FROM blk WHERE term = 'purchase'),
ic AS (SELECT src, dst, 'intra' AS kind FROM ie WHERE src NOT IN (SELECT node FROM site) UNION ALL SELECT -src, dst, 'intra' FROM ie WHERE src IN (SELECT node FROM site)
  UNION ALL SELECT s.node, e.node, 'call_to_entry' FROM site s JOIN entry_ e ON e.fn = s.fn UNION ALL SELECT x.node, -s.node, 'return_to_call' FROM site s JOIN exits x ON x.fn = s.fn
  UNION ALL SELECT node, -node, 'call_to_return' FROM site)"""


@query(f"{proxy_ctes(FLOW, INST, SITES, ICFG)} SELECT src, dst, kind FROM ic")
def icfg_edges(p):
    calls = _sites(p).select(F.col("node").alias("site"), "fn")
    entries = p.ins.where("ord = 0").select("fn", F.col("iid").alias("node"))
    exits = p.blk.where("term = 'purchase'").select("fn", F.col("tid").alias("node"))
    return icfg(flow.instruction_edges(p.ins, p.flow), calls, entries, exits)


def _ifds(p: EventProgram, extern: DataFrame | None = None) -> Problem:
    """Taint over four variables of a function. A view taints k % 4; a click copies k % 4 to
    iid % 4 (which loses its own); an error cleans k % 4; a call passes k % 4 to the callee's 0
    and gets the callee's 0 back into iid % 4; all other facts skip the callee. Function 0 and
    every tenth are entries. Nodes are iid + 1, so that a return node's negation differs. Further
    calls (extern) have the same local facts."""
    node = F.col("iid") + 1
    ins, sites = p.ins.select("fn", "iid", "op", "k"), _sites(p)
    facts = F.array(*[F.lit(i).cast("long") for i in range(-1, 4)])
    edges = flow.instruction_edges(p.ins, p.flow).where("dst <> -1")
    every = sites if extern is None else sites.unionByName(extern)
    called = every.select(F.col("src").alias("fn"), F.col("node").alias("iid"))
    pair = (
        "CASE WHEN d = -1 THEN IF(op = 'view', array(-1L, k % 4), array(-1L)) WHEN op = 'click' AND d = k % 4 THEN array_distinct(array(d, iid % 4)) "
        "WHEN op = 'click' AND d = iid % 4 THEN CAST(array() AS array<bigint>) WHEN op = 'error' AND d = k % 4 THEN CAST(array() AS array<bigint>) ELSE array(d) END"
    )
    plain = ins.join(called.select("iid"), "iid", "left_anti").withColumn("d", F.explode(facts)).withColumn("d2", F.explode(F.expr(pair)))
    succ = edges.select(F.col("src").alias("iid"), (F.col("dst") + 1).alias("succ"))
    f1 = plain.join(succ, "iid").select("fn", node.alias("node"), "succ", "d", "d2")
    f2 = called.withColumn("d", F.explode(facts)).join(succ, "iid").select("fn", (-node).alias("node"), "succ", "d", F.col("d").alias("d2"))
    c = sites.select(F.col("node").alias("iid"), "src", "fn", "k")
    pass_ = c.select(node.alias("node"), "fn", F.explode(F.expr("array(struct(-1L AS d, -1L AS d2), struct(k % 4 AS d, 0L AS d2))")).alias("x")).select("node", "fn", "x.d", "x.d2")
    back = c.select(node.alias("node"), "fn", F.lit(0).cast("long").alias("d"), (F.col("iid") % 4).alias("d2"))
    past = every.withColumnRenamed("node", "iid").withColumn("d", F.explode(facts)).where("d <> iid % 4").select(F.col("src").alias("fn"), node.alias("node"), "d", F.col("d").alias("d2"))
    entry = p.ins.where("ord = 0").select("fn", node.alias("node"))
    start = _nodes(p).where("fn % 10 = 0").select("fn", F.lit(-1).cast("long").alias("d"))
    exits = p.blk.where("term = 'purchase'").select((F.col("tid") + 1).alias("node"), "fn")
    return Problem(entry, start, f1.unionByName(f2), pass_, exits, back, past)


IFDS_BACK = "bk AS (SELECT node + 1 AS node, fn, CAST(0 AS BIGINT) AS d, node % 4 AS d2 FROM site)"
IFDS = """flowd AS (SELECT i.iid + 1 AS node, e.dst + 1 AS succ, d.d, i.op, i.k, i.iid FROM ins i JOIN ie e ON e.src = i.iid AND e.dst <> -1 CROSS JOIN (SELECT CAST(x AS BIGINT) AS d FROM range(-1, 4) t(x)) d WHERE i.iid NOT IN (SELECT node FROM site)),
fl AS (SELECT node, succ, d, d AS d2 FROM flowd WHERE d = -1 OR NOT ((op = 'click' AND d = iid % 4 AND d <> k % 4) OR (op = 'error' AND d = k % 4))
  UNION SELECT node, succ, d, k % 4 FROM flowd WHERE d = -1 AND op = 'view' UNION SELECT node, succ, d, iid % 4 FROM flowd WHERE op = 'click' AND d = k % 4
  UNION SELECT -(s.node + 1), e.dst + 1, d.x, d.x FROM site s JOIN ie e ON e.src = s.node AND e.dst <> -1 CROSS JOIN (SELECT CAST(x AS BIGINT) AS x FROM range(-1, 4) t(x)) d),
ps AS (SELECT node + 1 AS node, fn, CAST(-1 AS BIGINT) AS d, CAST(-1 AS BIGINT) AS d2 FROM site UNION SELECT node + 1, fn, k % 4, CAST(0 AS BIGINT) FROM site),
pa AS (SELECT s.node + 1 AS node, CAST(x AS BIGINT) AS d FROM site s CROSS JOIN range(-1, 4) t(x) WHERE x <> s.node % 4),
f AS (SELECT CAST(0 AS BIGINT) AS tag, e.fn AS a, CAST(-1 AS BIGINT) AS b, e.node + 1 AS c, CAST(-1 AS BIGINT) AS d FROM entry_ e WHERE e.fn % 10 = 0
 UNION (SELECT 0, p.a, p.b, fl.succ, fl.d2 FROM recurring.f p JOIN fl ON fl.node = p.c AND fl.d = p.d WHERE p.tag = 0
  UNION SELECT 0, p.a, p.b, -p.c, p.d FROM recurring.f p JOIN pa ON pa.node = p.c AND pa.d = p.d WHERE p.tag = 0
  UNION SELECT 0, ps.fn, ps.d2, e.node + 1, ps.d2 FROM recurring.f p JOIN ps ON ps.node = p.c AND ps.d = p.d JOIN entry_ e ON e.fn = ps.fn WHERE p.tag = 0
  UNION SELECT 1, ps.fn, ps.d2, p.c, p.d FROM recurring.f p JOIN ps ON ps.node = p.c AND ps.d = p.d WHERE p.tag = 0
  UNION SELECT 2, p.a, p.b, p.c, p.d FROM recurring.f p JOIN exits x ON x.node + 1 = p.c AND x.fn = p.a WHERE p.tag = 0
  UNION SELECT 3, 0, i.c, i.d, bk.d2 FROM recurring.f i JOIN recurring.f e ON e.tag = 2 AND e.a = i.a AND e.b = i.b JOIN bk ON bk.node = i.c AND bk.fn = i.a AND bk.d = e.d WHERE i.tag = 1
  UNION SELECT 0, p.a, p.b, -p.c, s.d FROM recurring.f p JOIN recurring.f s ON s.tag = 3 AND s.b = p.c AND s.c = p.d WHERE p.tag = 0))"""


@query(f"{proxy_ctes(FLOW, INST, SITES, ICFG, IFDS_BACK, IFDS)} SELECT DISTINCT c AS node, d AS fact FROM f WHERE tag = 0 AND c >= 0 AND d <> -1")
def ifds_reach(p):
    return Problem.facts(_ifds(p).solve())


@query(f"{proxy_ctes(FLOW, INST, SITES, ICFG, IFDS_BACK, IFDS)} SELECT r.relation, count(f.tag) AS n FROM (VALUES (0, 'path'), (1, 'incoming'), (2, 'end'), (3, 'summary')) r(tag, relation) LEFT JOIN f ON f.tag = r.tag GROUP BY r.relation")
def ifds_edge_count(p):
    return Problem.sizes(_ifds(p).solve())


def _extern_sites(p: EventProgram) -> DataFrame:
    """Calls of three functions without a body, numbered past the defined ones: the first returns
    its argument, the second nothing, and of the third, the unknown one, the result is tainted."""
    n = p.events.agg((F.max("user_id") + 1).alias("n"))
    return p.ins.where("op = 'signup' AND k % 16 = 1").join(F.broadcast(n)).select(F.col("iid").alias("node"), F.col("fn").alias("src"), F.expr("n + iid % 3").alias("fn"), "k")


#: The same calls, with sites, entries, exits and returns widened by them.
EXTERN = f"""bound AS (SELECT MAX(user_id) + 1 AS n, MAX(event_id) + 1 AS m FROM events),
{SITES.replace("site AS (", "site AS (SELECT i.iid AS node, i.fn AS src, n.n + i.iid % 3 AS fn, i.k FROM ins i CROSS JOIN bound n WHERE i.op = 'signup' AND i.k % 16 = 1 UNION ALL ")},
entry_ AS (SELECT fn, iid AS node FROM ins WHERE ord = 0 UNION ALL SELECT n + x, m + x FROM bound CROSS JOIN range(0, 3) r(x)),
exits AS (SELECT fn, tid AS node FROM blk WHERE term = 'purchase' UNION ALL SELECT n + x, m + x FROM bound CROSS JOIN range(0, 3) r(x)),
bk AS (SELECT node + 1 AS node, fn, CAST(CASE WHEN fn = n + 2 THEN -1 ELSE 0 END AS BIGINT) AS d, node % 4 AS d2 FROM site CROSS JOIN bound WHERE fn <> n + 1)"""


@query(f"{proxy_ctes(FLOW, INST, EXTERN, IFDS.replace('WHERE e.fn % 10 = 0', 'WHERE e.fn % 10 = 0 AND e.fn < (SELECT n FROM bound)'))} SELECT DISTINCT c AS node, d AS fact FROM f WHERE tag = 0 AND c >= 0 AND d <> -1")
def ifds_extern_reach(p):
    sites = _extern_sites(p)
    bound = p.events.agg((F.max("user_id") + 1).alias("n"), (F.max("event_id") + 2).alias("m"))
    externs = bound.withColumn("x", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    to = sites.select((F.col("node") + 1).alias("node"), F.col("node").alias("iid"), "fn", "k")
    pass_ = to.select("node", "fn", F.explode(F.expr("array(struct(-1L AS d, -1L AS d2), struct(k % 4 AS d, 0L AS d2))")).alias("x")).select("node", "fn", "x.d", "x.d2")
    gives = externs.where("x <> 1").select((F.col("n") + F.col("x")).alias("fn"), F.expr("IF(x = 2, -1L, 0L)").alias("d"))  # two rows
    back = to.join(F.broadcast(gives), "fn").select("node", "fn", "d", (F.col("iid") % 4).alias("d2"))
    bodiless = externs.select((F.col("n") + F.col("x")).alias("fn"), (F.col("m") + F.col("x")).alias("node"))
    return Problem.facts(_ifds(p, sites).with_externs(bodiless, pass_, back).solve())


# -- graph text -------------------------------------------------------------------------------
@query(f"{proxy_ctes(FLOW)} SELECT fn, '  ' || CAST(src AS VARCHAR) || ' -> ' || CAST(dst AS VARCHAR) || ';' AS line FROM flow")
def dot_cfg(p):
    return dot.edge_lines(p.flow, "fn")


@query(
    f"{proxy_ctes(RC, SCC)}, cl AS (SELECT scc, '  subgraph cluster_' || CAST(scc AS VARCHAR) || ' {{ ' || string_agg(CAST(fn AS VARCHAR), '; ' ORDER BY CAST(fn AS VARCHAR)) || '; }}' AS line FROM sc GROUP BY scc HAVING count(*) > 1) "
    "SELECT '  ' || CAST(src AS VARCHAR) || ' -> ' || CAST(dst AS VARCHAR) || ' [color=black];' AS line FROM cg UNION ALL SELECT line FROM cl"
)
def dot_callgraph(p):
    comp = C.scc(p.calls, _nodes(p))
    return dot.edge_lines(p.calls.withColumn("kind", F.lit("direct"))).unionByName(dot.clustered(comp.select(F.col("fn").alias("node"), F.col("scc").alias("cluster"))).select("line"))


__all__ = ["QUERIES", "SQL", "closure"]

# -- at instructions ----------------------------------------------------------------------------
@query(f"{proxy_ctes(FLOW, PLIVE, PAVOID, PDOM)} SELECT c.fn, c.dst AS a, c.src AS b, (c.src = c.dst OR EXISTS (SELECT 1 FROM pdom d WHERE d.fn = c.fn AND d.dom = c.dst AND d.block = c.src)) AS dominates FROM cfg c")
def postdominates(p):
    return flow.dominates(p.flow, p.cfg.select("fn", F.col("dst").alias("a"), F.col("src").alias("b")), post=True)


IDOM = """dep AS (SELECT fn, block, count(*) AS n FROM dom GROUP BY fn, block),
idm AS (SELECT d.fn, d.block, max_by(d.dom, coalesce(x.n, 0)) AS idom FROM dom d LEFT JOIN dep x ON x.fn = d.fn AND x.block = d.dom GROUP BY d.fn, d.block)"""


@query(
    f"""{proxy_ctes(LIVE, AVOID, DOM, IDOM)} SELECT z.fn, z.iid, a.iid AS idom FROM ins z JOIN live l ON l.fn = z.fn AND l.block = FLOOR(z.ord / 4.0) JOIN ins a ON a.fn = z.fn AND a.ord = z.ord - 1 WHERE z.ord % 4 <> 0 AND EXISTS (SELECT 1 FROM idm w WHERE w.fn = z.fn)
UNION ALL SELECT z.fn, z.iid, k.tid FROM ins z JOIN idm m ON m.fn = z.fn AND m.block = FLOOR(z.ord / 4.0) JOIN blk k ON k.fn = m.fn AND k.b = m.idom WHERE z.ord % 4 = 0"""
)
def idom_inst(p):
    return flow.instruction_immediate_dominators(_blocks(p), flow.immediate_dominators(p.cfg))


@query(
    f"""{proxy_ctes(LIVE, AVOID, DOM)}, i AS (SELECT fn, iid, ord, CAST(FLOOR(ord / 4.0) AS BIGINT) AS b FROM ins)
SELECT z.fn, z.iid, a.iid AS dom FROM i z JOIN live l ON l.fn = z.fn AND l.block = z.b JOIN i a ON a.fn = z.fn AND a.b = z.b AND a.ord < z.ord
UNION ALL SELECT z.fn, z.iid, a.iid FROM i z JOIN dom d ON d.fn = z.fn AND d.block = z.b JOIN i a ON a.fn = d.fn AND a.b = d.dom"""
)
def dominators_inst(p):
    return flow.instruction_dominators(_blocks(p), flow.dominators(p.cfg), flow.reachable_from_entry(p.flow))


LABEL = """lab AS (SELECT fn, b AS block, tid % 16 AS value FROM blk WHERE term = 'purchase'
  UNION SELECT c.fn, c.src, l.value FROM lab l JOIN flow c ON c.fn = l.fn AND c.dst = l.block JOIN pdom d ON d.fn = c.fn AND d.block = c.src AND d.dom = l.block)"""


def _returned(p: EventProgram) -> DataFrame:
    return p.blk.where("term = 'purchase'").select("fn", F.col("b").alias("block"), (F.col("tid") % 16).alias("value"))


@query(
    f"""{proxy_ctes(FLOW, PLIVE, PAVOID, PDOM, LABEL)} SELECT DISTINCT c.fn, c.src AS block FROM lab l JOIN flow c ON c.fn = l.fn AND c.dst = l.block
WHERE NOT EXISTS (SELECT 1 FROM pdom d WHERE d.fn = c.fn AND d.block = c.src AND d.dom = l.block) AND NOT EXISTS (SELECT 1 FROM lab z WHERE z.fn = c.fn AND z.block = c.src)"""
)
def poisoned_blocks(p):
    return A.block_returns(p.flow, _returned(p))[1]


@query(f"{proxy_ctes(FLOW, PLIVE, PAVOID, PDOM, LABEL)} SELECT i.fn, i.iid, l.value FROM ins i JOIN lab l ON l.fn = i.fn AND l.block = FLOOR(i.ord / 4.0)")
def instruction_return(p):
    return A.instruction_returns(_blocks(p), A.block_returns(p.flow, _returned(p))[0])


@query(
    f"""{proxy_ctes(FLOW)}, m AS (SELECT fn, b AS block, tid % 16 AS value FROM blk WHERE term = 'purchase' UNION SELECT c.fn, c.src, m.value FROM m JOIN flow c ON c.fn = m.fn AND c.dst = m.block)
SELECT fn, block, value FROM m"""
)
def may_return(p):
    return A.may_return(p.flow, _returned(p))


@query(
    f"""{proxy_ctes(FLOW, PLIVE, DEFS)}, lv AS (SELECT DISTINCT u.fn, u.b AS block, u.uv AS var FROM i u JOIN plive r ON r.fn = u.fn AND r.block = u.b WHERE u.uv IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM i d WHERE d.fn = u.fn AND d.b = u.b AND d.ord < u.ord AND d.dv = u.uv)
  UNION SELECT c.fn, c.src, l.var FROM lv l JOIN cfg c ON c.fn = l.fn AND c.dst = l.block WHERE NOT EXISTS (SELECT 1 FROM kill z WHERE z.fn = c.fn AND z.b = c.src AND z.v = l.var)),
pt AS (SELECT a.iid, u.uv AS v FROM i a JOIN plive r ON r.fn = a.fn AND r.block = a.b JOIN i u ON u.fn = a.fn AND u.b = a.b AND u.ord >= a.ord AND u.uv IS NOT NULL
    WHERE NOT EXISTS (SELECT 1 FROM i d WHERE d.fn = a.fn AND d.b = a.b AND d.ord >= a.ord AND d.ord < u.ord AND d.dv = u.uv)
  UNION SELECT a.iid, l.var FROM i a JOIN cfg c ON c.fn = a.fn AND c.src = a.b JOIN lv l ON l.fn = c.fn AND l.block = c.dst WHERE NOT EXISTS (SELECT 1 FROM i d WHERE d.fn = a.fn AND d.b = a.b AND d.ord >= a.ord AND d.dv = l.var))
SELECT i.fn, i.iid, count(pt.v) AS n_live FROM i LEFT JOIN pt ON pt.iid = i.iid GROUP BY i.fn, i.iid"""
)
def live_at(p):
    return A.live_at(p.flow, _defs(p))


# -- queries over instruction facts ---------------------------------------------------------------
QUADS = f"quad AS ({X.QUAD})"


def _kinds(src: str, rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT k.fn, k.b AS src, {dst} AS dst, '{kind}' AS kind FROM blk k JOIN fns f ON f.fn = k.fn WHERE {where}" for dst, kind, where in rows)


FACT_FLOW = _kinds(
    "blk",
    [
        ("LEAST(k.b + 2 + k.tid % 3, f.mb)", "true", "k.term = 'click' AND k.b < f.mb"), ("k.b + 1", "false", "k.term = 'click' AND k.b < f.mb"), ("k.b + 1", "other", "k.term = 'error' AND k.b < f.mb"),
        ("GREATEST(k.b - 2, 0)", "equality", "k.term = 'error' AND k.b < f.mb"), ("k.b + 1", "other", "k.term IN ('view', 'signup') AND k.b < f.mb"), ("-1", "other", "k.term = 'purchase' OR k.b = f.mb"),
    ],
)


@query(f"{proxy_ctes()} SELECT fn + {X.FN} AS fn, src, dst, kind FROM ({FACT_FLOW})")
def ir_flow_edges(p):
    return ir.flow_edges(X.facts(p)).select("fn", "src", "dst", "kind")


@query(
    f"{proxy_ctes(QUADS)} SELECT q.fn + {X.FN} AS fn, q.b, q.i0 AS value, CASE WHEN q.k1 % 3 = 0 THEN LEAST(q.b + 2 + q.i3 % 3, f.mb) ELSE q.b + 1 END AS null_block, "
    "CASE WHEN q.k1 % 3 = 0 THEN q.b + 1 ELSE LEAST(q.b + 2 + q.i3 % 3, f.mb) END AS other_block FROM quad q JOIN fns f ON f.fn = q.fn JOIN blk k ON k.fn = q.fn AND k.b = q.b "
    "WHERE q.t = 1 AND k.term = 'click' AND q.b < f.mb AND q.k1 % 3 < 2 AND (q.k1 % 2 = 0 OR q.k1 % 5 <> 0)"
)
def ir_null_tests(p):
    return ir.branch_null_tests(X.facts(p))


@query(
    f"""{proxy_ctes(QUADS)}, e AS (SELECT i2, fn, k0, k1, k2, {X.ADDED} AS c FROM quad WHERE t = 0)
SELECT i2 AS inst_id, {X.slot("k0")} AS address, CAST(CASE WHEN k1 % 2 = 0 THEN c ELSE -c END AS BIGINT) AS effect FROM e WHERE c <> 2 AND k2 % 4 <> 0 AND (k1 % 2 = 0 OR k1 % 3 <> 0)
UNION ALL SELECT i2, {X.slot("k2")}, CAST(CASE WHEN k2 % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) FROM quad WHERE t = 1 AND k2 % 3 = 0"""
)
def ir_increments(p):
    return ir.increments(X.facts(p))


@query(
    f"""{proxy_ctes(QUADS)} SELECT fn + {X.FN} AS fn, i2 AS iid, {X.STORED_TO} AS root, 'Deref' AS path FROM quad WHERE t = 0
UNION ALL SELECT fn + {X.FN}, i2, {X.slot("k2")}, 'Deref' FROM quad WHERE t = 1
UNION ALL SELECT fn + {X.FN}, i2, {X.slot("k0")}, 'Deref.Deref' || CASE WHEN k1 % 3 = 0 OR k1 % 4 = 3 THEN '.Array' ELSE '' END ||
  CASE WHEN k1 % 4 = 0 THEN '.Field' || CAST(k2 % 4 AS VARCHAR) WHEN k1 % 4 < 3 THEN '.Field1.Field' || CAST(k2 % 3 AS VARCHAR) ELSE '' END FROM quad WHERE t = 2
UNION ALL SELECT fn + {X.FN}, i2, {X.slot("k0 + k2")}, 'Deref' FROM quad WHERE t = 3"""
)
def ir_written_paths(p):
    program = X.facts(p)
    writes = program.instructions.where("opcode IN ('store', 'atomicrmw')").select(F.col("inst_id").alias("iid"))
    return ir.memory_paths(program).join(writes, "iid", "left_semi").select("fn", "iid", "root", "path")


HELD = f"""st AS (SELECT {X.slot("k0 + k2")} AS g, {X.POINTED} AS v, k2 % 3 AS how, {X.slot("k0")} AS src FROM quad WHERE t = 3
  UNION ALL SELECT {X.slot("k0")}, {X.slot("k2")}, 1, -1 FROM quad WHERE t = 2 AND k1 % 4 = 3),
held AS (SELECT g, v FROM st WHERE how <> 0 UNION SELECT st.g, h.v FROM held h JOIN st ON st.how = 0 AND st.src = h.g)"""


@query(
    f"""{proxy_ctes(QUADS, HELD)}, args AS (SELECT {X.CALLED} - {X.FN} AS f, {X.slot("k1")} AS v FROM quad WHERE t = 3 AND k1 % 2 = 0
  UNION SELECT h.v - {X.FN}, q.g1 FROM (SELECT {X.slot("k0")} AS g0, {X.slot("k1")} AS g1 FROM quad WHERE t = 3 AND k1 % 2 = 1) q JOIN held h ON h.g = q.g0 AND h.v BETWEEN {X.FN} AND {X.ARG - 1})
SELECT g AS value_id, v AS target FROM held UNION SELECT f + {X.ARG}, v FROM args"""
)
def ir_points_to(p):
    return Artefacts.of(X.facts(p))["held"].where(f"value_id BETWEEN {X.ARG} AND {X.CONST - 1}")


@query(
    f"""{proxy_ctes(QUADS, HELD)}, c AS (SELECT fn + {X.FN} AS src, {X.CALLED} AS f, k1 % 2 AS how, {X.slot("k0")} AS g FROM quad WHERE t = 3)
SELECT DISTINCT src, f AS dst, 'direct' AS kind FROM c WHERE how = 0 UNION ALL SELECT DISTINCT src, -100, 'unknown' FROM c WHERE how = 1
UNION ALL SELECT DISTINCT src, h.v, 'indirect' FROM c JOIN held h ON h.g = c.g WHERE how = 1 AND h.v BETWEEN {X.FN} AND {X.ARG - 1}"""
)
def ir_call_edges(p):
    return Artefacts.of(X.facts(p))["calls"]


@query(f"{proxy_ctes()} SELECT fn + {X.FN} AS fn, fn + {X.ARG} AS value_id, CAST({X.STRUCT_PP} AS BIGINT) AS type_id FROM fns UNION ALL SELECT fn + {X.FN}, {X.GLOBAL} + fn * 8 + s, {X.STRUCT_PP} FROM fns CROSS JOIN range(0, 8) r(s)")
def ir_value_types(p):
    program = X.facts(p)
    t = ir.value_types(program).where(f"value_id BETWEEN {X.ARG} AND {X.CONST - 1}")
    return t.select(F.expr(f"CASE WHEN value_id < {X.GLOBAL} THEN value_id - {X.ARG - X.FN} ELSE (value_id - {X.GLOBAL}) div 8 + {X.FN} END").alias("fn"), "value_id", "type_id")


@query(
    f"""{proxy_ctes(QUADS, HELD)}, c AS (SELECT i1 AS site, {X.CALLED} AS f, k1 % 2 AS how, {X.slot("k0")} AS g, {X.FN} + n AS u FROM quad WHERE t = 3),
tg AS (SELECT site, f FROM c WHERE how = 0 UNION SELECT site, h.v FROM c JOIN held h ON h.g = c.g WHERE how = 1 AND h.v BETWEEN {X.FN} AND {X.ARG - 1}),
hd AS (SELECT k.fn, k.b, COALESCE(q.i0, k.tid) AS node FROM blk k LEFT JOIN quad q ON q.fn = k.fn AND q.b = k.b), fe AS (SELECT DISTINCT fn, src, dst FROM ({FACT_FLOW}) WHERE dst <> -1)
SELECT i0 AS src, i1 AS dst, 'intra' AS kind FROM quad UNION ALL SELECT CASE WHEN t = 3 THEN -i1 ELSE i1 END, i2, 'intra' FROM quad UNION ALL SELECT i2, i3, 'intra' FROM quad
UNION ALL SELECT k.tid, h.node, 'intra' FROM fe JOIN blk k ON k.fn = fe.fn AND k.b = fe.src JOIN hd h ON h.fn = fe.fn AND h.b = fe.dst
UNION ALL SELECT site, -site, 'call_to_return' FROM c UNION ALL SELECT tg.site, h.node, 'call_to_entry' FROM tg JOIN hd h ON h.fn + {X.FN} = tg.f AND h.b = 0
UNION ALL SELECT k.tid, -tg.site, 'return_to_call' FROM tg JOIN blk k ON k.fn + {X.FN} = tg.f AND k.term = 'purchase'
UNION ALL SELECT site, u, 'call_to_entry' FROM c WHERE how = 1 UNION ALL SELECT u, -site, 'return_to_call' FROM c WHERE how = 1"""
)
def ir_icfg(p):
    program = X.facts(p)
    # A library: every function may be entered from outside.
    return program_icfg(program, Artefacts.of(program)["points_to"], ir.function_nodes(program))

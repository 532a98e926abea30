"""The registered queries of the engine, each with the DuckDB SQL that must give the same rows.

Most read `events` as one program (see `codeloom.sources.events`), so every
relation runs over the whole table; events have no branches and nest one
deep, so `nested_*` read regions to orders as another program, with branches
and loops four deep.  A few queries write the events as program texts and
parse those, some of them made faulty first; `lines_*` write them as one
program and read it by lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.tables import shared_folder
from codeloom.operators import subtrees
from codeloom.operators.closure import closure_acyclic
from codeloom.operators.stored import StoredClosure
from codeloom.plans.facts import Facts
from codeloom.plans.query import Query, name
from codeloom.sources import store
from codeloom.sources.events import PROGRAM, from_events
from codeloom.sources.orders import from_orders
from codeloom.sources.programs import from_programs, parse_errors, read_lines
from codeloom.sources.texts import FAULTS, faulty_texts, program_texts, written_program

_BASE = """
WITH RECURSIVE e AS (SELECT event_id AS no, user_id AS proc, ts, event_type AS et, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events),
b AS (SELECT *, CASE WHEN et = 'signup' THEN 'read' WHEN et = 'view' THEN 'print' WHEN et = 'error' THEN 'while' WHEN et = 'purchase' AND k < 10 THEN 'call' ELSE 'assign' END AS type,
      row_number() OVER (PARTITION BY proc ORDER BY ts, no) AS ord FROM e),
w AS (SELECT *, last_value(CASE WHEN type = 'while' THEN no END IGNORE NULLS) OVER (PARTITION BY proc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS loop FROM b),
s AS (SELECT *, CASE WHEN type <> 'while' THEN loop END AS parent, coalesce(CASE WHEN type <> 'while' THEN loop END, -1) AS block,
      CASE WHEN type = 'assign' THEN 'v' || (k % 20) END AS lhs, CASE WHEN type IN ('read', 'print') THEN 'v' || (k % 20) END AS io,
      CASE WHEN type = 'call' AND EXISTS (SELECT 1 FROM e u WHERE u.proc = w.proc + (1 << (w.k % 8))) THEN w.proc + (1 << (k % 8)) END AS callee,
      '((v' || ((k * 7 + 3) % 20) || ')+(' || k || '))' AS expr FROM w),
ud AS (SELECT no, proc, CASE WHEN type = 'assign' THEN 'v' || ((k * 7 + 3) % 20) ELSE 'v' || (k % 20) END AS v FROM s WHERE type IN ('assign', 'print', 'while')),
md AS (SELECT no, proc, 'v' || (k % 20) AS v FROM s WHERE type IN ('assign', 'read')),
sib AS (SELECT *, lead(no) OVER (PARTITION BY proc, block ORDER BY ord) AS sibling FROM s),
nx AS (SELECT no AS l, coalesce(sibling, parent) AS r FROM sib WHERE coalesce(sibling, parent) IS NOT NULL
       UNION SELECT parent, arg_min(no, ord) FROM s WHERE parent IS NOT NULL GROUP BY parent),
ct AS (SELECT DISTINCT proc AS p, callee AS q FROM s WHERE callee IS NOT NULL UNION SELECT ct.p, s.callee FROM ct JOIN s ON s.proc = ct.q WHERE s.callee IS NOT NULL),
up AS (SELECT proc AS p, v FROM ud UNION SELECT ct.p, ud.v FROM ct JOIN ud ON ud.proc = ct.q),
mp AS (SELECT proc AS p, v FROM md UNION SELECT ct.p, md.v FROM ct JOIN md ON md.proc = ct.q),
us0 AS (SELECT no, v FROM ud UNION SELECT s.no, up.v FROM s JOIN up ON up.p = s.callee),
us AS (SELECT no, v FROM us0 UNION SELECT s.parent, us0.v FROM us0 JOIN s USING (no) WHERE s.parent IS NOT NULL),
ms0 AS (SELECT no, v FROM md UNION SELECT s.no, mp.v FROM s JOIN mp ON mp.p = s.callee),
ms AS (SELECT no, v FROM ms0 UNION SELECT s.parent, ms0.v FROM ms0 JOIN s USING (no) WHERE s.parent IS NOT NULL),
af AS (SELECT s.no AS a, s.lhs AS v, nx.r AS n FROM s JOIN nx ON nx.l = s.no WHERE s.type = 'assign'
       UNION SELECT af.a, af.v, nx.r FROM af JOIN nx ON nx.l = af.n LEFT JOIN (SELECT m.no, m.v FROM ms0 m) k ON k.no = af.n AND k.v = af.v WHERE k.no IS NULL),
afs AS (SELECT DISTINCT a AS l, n AS r FROM af JOIN s ON s.no = af.n AND s.type = 'assign' JOIN ud ON ud.no = af.n AND ud.v = af.v)
"""

Build = Callable[[Facts], DataFrame]
#: Name to (builder over the events' facts, SQL after the shared tables).
EVENTS: dict[str, tuple[Build, str]] = {}


def pairs(relation: str) -> Build:
    return lambda f: f.relation(relation).select("l", "r")


def add(key: str, build: Build, sql: str) -> None:
    EVENTS[key] = (build, sql)


def query(build: Callable[[Facts], DataFrame]) -> Build:
    return lambda f: build(f).drop("program_id")


for kind in ("assign", "read", "print", "call", "while"):
    add(f"scan_{kind}", query(lambda f, k=kind: Query(f, x=k).select("x")), f"SELECT no AS x FROM s WHERE type = '{kind}'")
add("scan_stmt", query(lambda f: Query(f, x="stmt").select("x")), "SELECT no AS x FROM s")
add("scan_prog_line", query(lambda f: Query(f, x="prog_line").select("x")), "SELECT no AS x FROM s")
add("scan_if", query(lambda f: Query(f, x="if").select("x")), "SELECT no AS x FROM s WHERE type = 'if'")
add("scan_variable", query(lambda f: Query(f, x="variable").select("x")), "SELECT v AS x FROM ud UNION SELECT v FROM md")
add("scan_constant", query(lambda f: Query(f, x="constant").select("x")), "SELECT DISTINCT CAST(k AS VARCHAR) AS x FROM s")
add("scan_procedure", query(lambda f: Query(f, x="procedure").select("x")), "SELECT DISTINCT CAST(proc AS VARCHAR) AS x FROM s")

add("follows", pairs("follows"), "SELECT no AS l, sibling AS r FROM sib WHERE sibling IS NOT NULL")
add("follows_t", pairs("follows_t"), "SELECT a.no AS l, b.no AS r FROM s a JOIN s b ON a.proc = b.proc AND a.block = b.block AND a.ord < b.ord")
add("parent", pairs("parent"), "SELECT parent AS l, no AS r FROM s WHERE parent IS NOT NULL")
add("parent_t", pairs("parent_t"), "SELECT parent AS l, no AS r FROM s WHERE parent IS NOT NULL")
add("calls", pairs("calls"), "SELECT DISTINCT CAST(proc AS VARCHAR) AS l, CAST(callee AS VARCHAR) AS r FROM s WHERE callee IS NOT NULL")
add("calls_t", pairs("calls_t"), "SELECT CAST(p AS VARCHAR) AS l, CAST(q AS VARCHAR) AS r FROM ct")
add("uses_s", pairs("uses_s"), "SELECT no AS l, v AS r FROM us")
add("uses_p", pairs("uses_p"), "SELECT CAST(p AS VARCHAR) AS l, v AS r FROM up")
add("modifies_s", pairs("modifies_s"), "SELECT no AS l, v AS r FROM ms")
add("modifies_p", pairs("modifies_p"), "SELECT CAST(p AS VARCHAR) AS l, v AS r FROM mp")
add("next", pairs("next"), "SELECT l, r FROM nx")
_NEXT_T = ", nt AS (SELECT l, r FROM nx UNION SELECT nt.l, nx.r FROM nt JOIN nx ON nx.l = nt.r)"
add("next_t", pairs("next_t"), _NEXT_T + " SELECT l, r FROM nt")
add("next_self", query(lambda f: Query(f, n="prog_line").such_that("Next*", "n", "n").select("n")), _NEXT_T + " SELECT l AS n FROM nt WHERE l = r")
add("affects", pairs("affects"), "SELECT l, r FROM afs")
_AFFECTS_T = ", aft AS (SELECT l, r FROM afs UNION SELECT aft.l, afs.r FROM aft JOIN afs ON afs.l = aft.r)"
add("affects_t", pairs("affects_t"), _AFFECTS_T + " SELECT l, r FROM aft")

# Across calls: what a procedure returns to, with calls that end their procedure passed on; steps of a walk in phase 0 may return, those in phase 1 are below a call.
_BIP = """, fs AS (SELECT proc, arg_min(no, ord) AS first FROM s GROUP BY proc),
fc AS (SELECT s.no, s.proc, s.callee, fs.first FROM s JOIN fs ON fs.proc = s.callee),
lf AS (SELECT no, proc FROM sib WHERE sibling IS NULL AND parent IS NULL),
tl AS (SELECT callee AS p, callee AS q FROM fc UNION SELECT tl.p, fc.callee FROM tl JOIN fc ON fc.proc = tl.q JOIN lf ON lf.no = fc.no),
rt AS (SELECT DISTINCT tl.q AS p, nx.r FROM fc JOIN nx ON nx.l = fc.no JOIN tl ON tl.p = fc.callee),
st AS (SELECT l, r, 'next' AS kind FROM nx UNION SELECT no, first, 'call' FROM fc UNION SELECT lf.no, rt.r, 'return' FROM lf JOIN rt ON rt.p = lf.proc)"""
add("events_next_bip", pairs("next_bip"), _BIP + " SELECT l, r FROM st WHERE kind = 'call' OR l NOT IN (SELECT no FROM fc)")
_WALK = """, wk AS (SELECT l AS a, r AS n, CASE WHEN kind = 'call' THEN 1 ELSE 0 END AS ph FROM st
UNION SELECT wk.a, st.r, CASE WHEN st.kind = 'call' THEN 1 ELSE ph END FROM wk JOIN st ON st.l = wk.n WHERE st.kind <> 'return' OR wk.ph = 0)"""
add("events_next_bip_t", pairs("next_bip_t"), _BIP + _WALK + " SELECT DISTINCT a AS l, n AS r FROM wk")
# Values across calls, by walks that know the calls they have entered: before a statement or `done` with it, a call included.
_FLOW = """, gm AS (SELECT DISTINCT nx.l, nx.r, d.done, 'next' AS kind FROM nx, (VALUES (true), (false)) d(done) WHERE d.done OR nx.l NOT IN (SELECT no FROM fc)
  UNION ALL SELECT no, first, false, 'call' FROM fc
  UNION ALL SELECT lf.no, NULL, d.done, 'pop' FROM lf, (VALUES (true), (false)) d(done) WHERE d.done OR lf.no NOT IN (SELECT no FROM fc)
  UNION ALL SELECT lf.no, fc.no, d.done, 'up' FROM lf JOIN fc ON fc.callee = lf.proc, (VALUES (true), (false)) d(done) WHERE d.done OR lf.no NOT IN (SELECT no FROM fc)),
tn AS (SELECT s.no, ud.v AS u, s.lhs AS w FROM s JOIN ud USING (no) WHERE s.type = 'assign' AND s.lhs IS NOT NULL),
wa AS (SELECT no AS a, lhs AS v, no AS n, true AS done, CAST([] AS BIGINT[]) AS st FROM s WHERE type = 'assign' AND lhs IS NOT NULL
UNION SELECT * FROM (
  SELECT w.a, CASE WHEN x.turn THEN t.w ELSE w.v END AS v, CASE m.kind WHEN 'pop' THEN list_last(w.st) ELSE m.r END AS n, m.kind IN ('pop', 'up') AS done,
         CASE m.kind WHEN 'call' THEN list_append(w.st, w.n) WHEN 'pop' THEN w.st[:-2] ELSE w.st END AS st
  FROM wa w JOIN gm m ON m.l = w.n AND m.done = w.done CROSS JOIN (VALUES %s) x(turn)
  LEFT JOIN md k ON k.no = w.n AND k.v = w.v AND NOT w.done LEFT JOIN tn t ON t.no = w.n AND t.u = w.v AND NOT w.done
  WHERE CASE WHEN x.turn THEN t.no IS NOT NULL ELSE k.no IS NULL END AND CASE m.kind WHEN 'pop' THEN len(w.st) > 0 WHEN 'up' THEN len(w.st) = 0 ELSE true END))
SELECT DISTINCT wa.a AS l, wa.n AS r FROM wa JOIN tn ON tn.no = wa.n AND tn.u = wa.v WHERE NOT wa.done"""
add("events_affects_bip", pairs("affects_bip"), _BIP + _FLOW % "(false)")
add("events_affects_bip_t", pairs("affects_bip_t"), _BIP + _FLOW % "(false), (true)")
# Bound arguments: derived for the bindings alone.
_ONLY = lambda flow, no: flow.replace("lhs IS NOT NULL\nUNION", f"lhs IS NOT NULL AND no = {no}\nUNION")
add("affects_from", query(lambda f: Query(f, b="assign").such_that("Affects", 8, "b").select("b")), "SELECT r AS b FROM afs WHERE l = 8")
add("affects_t_from", query(lambda f: Query(f, b="assign").such_that("Affects*", 8, "b").select("b")), _AFFECTS_T + " SELECT r AS b FROM aft WHERE l = 8")
add("affects_t_of_loop", query(lambda f: Query(f, a="assign", b="assign").such_that("Parent", 398, "a").such_that("Affects*", "a", "b").select("a", "b")), _AFFECTS_T + " SELECT l AS a, r AS b FROM aft JOIN s ON s.no = aft.l WHERE s.parent = 398")
add("affects_bip_from", query(lambda f: Query(f, b="assign").such_that("AffectsBip", 8, "b").select("b")), "SELECT r AS b FROM (" + _BASE + _BIP + _ONLY(_FLOW % "(false)", 8) + ")")
add("affects_bip_t_from", query(lambda f: Query(f, b="assign").such_that("AffectsBip*", 8, "b").select("b")), "SELECT r AS b FROM (" + _BASE + _BIP + _ONLY(_FLOW % "(false), (true)", 8) + ")")
add("next_bip_t_to", query(lambda f: Query(f, n="prog_line").such_that("NextBip*", "n", 8).select("n")), _BIP + _WALK + " SELECT DISTINCT a AS n FROM wk WHERE n = 8")
add("calls_t_from", query(lambda f: Query(f, p="procedure").such_that("Calls*", name("74"), "p").select("p")), "SELECT CAST(q AS VARCHAR) AS p FROM ct WHERE p = 74")
add("uses_proc_name", query(lambda f: Query(f, p="procedure").such_that("Uses", "p", name("v3")).select("p")), "SELECT CAST(p AS VARCHAR) AS p FROM up WHERE v = 'v3'")
add("uses_of_proc", query(lambda f: Query(f, v="variable").such_that("Uses", name("74"), "v").select("v")), "SELECT v FROM up WHERE p = 74")
# Starred relations between synonyms that other clauses bring together test rows.
add("next_t_tested", query(lambda f: Query(f, a="assign", b="assign").such_that("Affects", "a", "b").such_that("Next*", "b", "a").select("a", "b")), _NEXT_T + " SELECT afs.l AS a, afs.r AS b FROM afs JOIN nt ON nt.l = afs.r AND nt.r = afs.l")
add("follows_t_tested", query(lambda f: Query(f, a="assign", b="assign").such_that("Affects", "a", "b").such_that("Follows*", "a", "b").select("a", "b")), "SELECT afs.l AS a, afs.r AS b FROM afs JOIN s x ON x.no = afs.l JOIN s y ON y.no = afs.r WHERE x.proc = y.proc AND x.block = y.block AND x.ord < y.ord")

add("follows_lit", query(lambda f: Query(f, x="stmt").such_that("Follows", 11, "x").select("x")), "SELECT sibling AS x FROM sib WHERE no = 11 AND sibling IS NOT NULL")
add("follows_t_assign", query(lambda f: Query(f, a="assign", w="while").such_that("Follows*", "a", "w").select("a", "w")), "SELECT a.no AS a, b.no AS w FROM s a JOIN s b ON a.proc = b.proc AND a.block = b.block AND a.ord < b.ord WHERE a.type = 'assign' AND b.type = 'while'")
add("follows_bool", query(lambda f: Query(f).such_that("Follows", "_", "_").boolean()), "SELECT count(*) > 0 AS holds FROM sib WHERE sibling IS NOT NULL")
add("parent_wild", query(lambda f: Query(f, w="while").such_that("Parent", "w", "_").select("w")), "SELECT DISTINCT parent AS w FROM s WHERE parent IS NOT NULL")
add("uses_name", query(lambda f: Query(f, x="stmt").such_that("Uses", "x", name("v3")).select("x")), "SELECT no AS x FROM us WHERE v = 'v3'")
add("modifies_proc_name", query(lambda f: Query(f, p="procedure").such_that("Modifies", "p", name("v3")).select("p")), "SELECT CAST(p AS VARCHAR) AS p FROM mp WHERE v = 'v3'")
add("calls_name", query(lambda f: Query(f, p="procedure").such_that("Calls*", "p", name("40")).select("p")), "SELECT CAST(p AS VARCHAR) AS p FROM ct WHERE q = 40")
add("pattern_any", query(lambda f: Query(f, a="assign").pattern("a").select("a")), "SELECT no AS a FROM s WHERE type = 'assign'")
add("pattern_variable", query(lambda f: Query(f, a="assign", v="variable").pattern("a", "v").select("a", "v")), "SELECT no AS a, lhs AS v FROM s WHERE type = 'assign'")
add("pattern_exact", query(lambda f: Query(f, a="assign").pattern("a", exact="v17 + 42").select("a")), "SELECT no AS a FROM s WHERE type = 'assign' AND expr = '((v17)+(42))'")
add("pattern_partial", query(lambda f: Query(f, a="assign", v="variable").pattern("a", "v", part="v17").select("a", "v")), "SELECT no AS a, lhs AS v FROM s WHERE type = 'assign' AND contains(expr, '(v17)')")
add("pattern_while", query(lambda f: Query(f, w="while", v="variable").pattern("w", "v").select("w", "v")), "SELECT no AS w, v FROM ud JOIN s USING (no) WHERE s.type = 'while'")
add("pattern_while_name", query(lambda f: Query(f, w="while").pattern("w", name("v5")).select("w")), "SELECT no AS w FROM ud JOIN s USING (no) WHERE s.type = 'while' AND v = 'v5'")
add("with_int", query(lambda f: Query(f, x="stmt").with_("x.stmt#", 12).select("x")), "SELECT no AS x FROM s WHERE no = 12")
add("with_prog_line", query(lambda f: Query(f, n="prog_line", c="constant").with_("n", "c.value").select("n")), "SELECT no AS n FROM s WHERE no IN (SELECT k FROM s)")
add("with_ident", query(lambda f: Query(f, r="read").with_("r.varName", name("v3")).select("r")), "SELECT no AS r FROM s WHERE type = 'read' AND io = 'v3'")
add("with_attr_attr", query(lambda f: Query(f, r="read", p="print").such_that("Follows", "r", "p").with_("r.varName", "p.varName").select("r", "p")), "SELECT a.no AS r, a.sibling AS p FROM sib a JOIN s b ON b.no = a.sibling WHERE a.type = 'read' AND b.type = 'print' AND a.io = b.io")
add("with_stmt_value", query(lambda f: Query(f, a="assign", c="constant").with_("a.stmt#", "c.value").select("a", "c.value")), "SELECT no AS a, CAST(no AS VARCHAR) AS c_value FROM s WHERE type = 'assign' AND no IN (SELECT k FROM s)")
add("with_procname", query(lambda f: Query(f, c="call", p="procedure", v="variable").with_("c.procName", "p.procName").such_that("Modifies", "p", "v").select("c", "v")), "SELECT s.no AS c, mp.v FROM s JOIN mp ON mp.p = s.callee")
add("with_stmt_stmt", query(lambda f: Query(f, a="assign", n="prog_line").with_("a.stmt#", "n").such_that("Parent", "_", "n").select("a")), "SELECT no AS a FROM s WHERE type = 'assign' AND parent IS NOT NULL")
add("with_cross_kind", query(lambda f: Query(f, p="procedure", v="variable").with_("p.procName", "v.varName").select("p")), "SELECT CAST(proc AS VARCHAR) AS p FROM s WHERE CAST(proc AS VARCHAR) IN (SELECT v FROM ud)")
add("with_constants", query(lambda f: Query(f, a="constant", b="constant").with_("a.value", "b.value").select("a", "b")), "SELECT DISTINCT CAST(k AS VARCHAR) AS a, CAST(k AS VARCHAR) AS b FROM s")
add("with_literals", query(lambda f: Query(f).with_(3, 3).with_(name("x"), name("y")).boolean()), "SELECT false AS holds")
add("select_tuple", query(lambda f: Query(f, w="while", a="assign").such_that("Parent", "w", "a").select("w", "a", "w")), "SELECT parent AS w, no AS a, parent AS w_2 FROM s WHERE type = 'assign' AND parent IS NOT NULL")
add("select_boolean_true", query(lambda f: Query(f, w="while").such_that("Parent*", "w", "_").boolean()), "SELECT true AS holds")
add("select_boolean_false", query(lambda f: Query(f, i="if").such_that("Parent", "i", "_").boolean()), "SELECT false AS holds")
add("select_independent_cross", query(lambda f: Query(f, v="variable", c="constant").select("v", "c")), "SELECT x.v, y.k AS c FROM (SELECT v FROM ud UNION SELECT v FROM md) x, (SELECT DISTINCT CAST(k AS VARCHAR) AS k FROM s) y")
add("select_attr", query(lambda f: Query(f, c="call").select("c", "c.procName")), "SELECT no AS c, CAST(callee AS VARCHAR) AS c_procName FROM s WHERE type = 'call' AND callee IS NOT NULL")
add("select_no_clause", query(lambda f: Query(f, r="read").select("r.varName")), "SELECT DISTINCT io AS r_varName FROM s WHERE type = 'read'")
add("join_shared_syn", query(lambda f: Query(f, a="assign", v="variable", p="print").such_that("Modifies", "a", "v").such_that("Follows", "a", "p").such_that("Uses", "p", "v").select("a", "p", "v")), "SELECT a.no AS a, b.no AS p, a.lhs AS v FROM sib a JOIN s b ON b.no = a.sibling WHERE a.type = 'assign' AND b.type = 'print' AND b.io = a.lhs")
add("join_two_shared", query(lambda f: Query(f, a="assign", b="assign", w="while").such_that("Affects", "a", "b").such_that("Parent", "w", "a").such_that("Parent", "w", "b").select("a", "b", "w")), "SELECT afs.l AS a, afs.r AS b, x.parent AS w FROM afs JOIN s x ON x.no = afs.l JOIN s y ON y.no = afs.r WHERE x.parent = y.parent")
add("group_existence", query(lambda f: Query(f, r="read", w="while", p="procedure").such_that("Follows", "r", "w").such_that("Calls", "p", "_").select("r")), "SELECT a.no AS r FROM sib a JOIN s b ON b.no = a.sibling WHERE a.type = 'read' AND b.type = 'while' AND EXISTS (SELECT 1 FROM ct)")
add("group_cartesian", query(lambda f: Query(f, w="while", v="variable", c="constant").pattern("w", "v").with_("c.value", 7).select("v", "c")), "SELECT DISTINCT v, '7' AS c FROM ud JOIN s USING (no) WHERE s.type = 'while' AND EXISTS (SELECT 1 FROM s WHERE k = 7)")
add("dup_clause", query(lambda f: Query(f, a="assign").such_that("Parent", "_", "a").such_that("Parent", "_", "a").select("a")), "SELECT no AS a FROM s WHERE type = 'assign' AND parent IS NOT NULL")
add("empty_group", query(lambda f: Query(f, a="assign", i="if").such_that("Parent", "i", "_").select("a")), "SELECT no AS a FROM s WHERE false")
add("flow_of_variables", query(lambda f: Query(f, a="assign", b="assign", v="variable").such_that("Affects", "a", "b").such_that("Uses", "b", "v").such_that("Modifies", "a", "v").select("a", "b", "v")), "SELECT afs.l AS a, afs.r AS b, x.lhs AS v FROM afs JOIN s x ON x.no = afs.l")

# Clauses that meet in cycles and trees: the joins of two tables alone would be far larger than the answers.
add("cycle_of_three", query(lambda f: Query(f, p="print", v="variable", r="read").such_that("Uses", "p", "v").such_that("Modifies", "r", "v").such_that("Next", "r", "p").select("r", "p", "v")), "SELECT x.no AS r, y.no AS p, x.io AS v FROM nx JOIN s x ON x.no = nx.l JOIN s y ON y.no = nx.r WHERE x.type = 'read' AND y.type = 'print' AND x.io = y.io")
add("cycle_of_four", query(lambda f: Query(f, p="print", v="variable", r="read", w="while").such_that("Uses", "p", "v").such_that("Modifies", "r", "v").such_that("Parent", "w", "r").such_that("Parent", "w", "p").select("w", "v")), "SELECT DISTINCT x.parent AS w, x.io AS v FROM s x JOIN s y ON x.parent = y.parent AND x.io = y.io WHERE x.type = 'read' AND y.type = 'print'")
add("tree_of_clauses", query(lambda f: Query(f, p="print", v="variable", r="read", w="while").such_that("Uses", "p", "v").such_that("Modifies", "r", "v").such_that("Parent", "w", "p").select("r")), "SELECT no AS r FROM s WHERE type = 'read' AND io IN (SELECT io FROM s WHERE type = 'print' AND parent IS NOT NULL)")
add("tree_outwards", query(lambda f: Query(f, p="print", v="variable", r="read", w="while", c="call").such_that("Uses", "p", "v").such_that("Modifies", "r", "v").such_that("Parent", "w", "p").such_that("Follows", "c", "r").select("v", "w")), "SELECT DISTINCT io AS v, parent AS w FROM s WHERE type = 'print' AND parent IS NOT NULL AND io IN (SELECT y.io FROM sib JOIN s y ON y.no = sib.sibling WHERE sib.type = 'call' AND y.type = 'read')")
add("product_of_groups", query(lambda f: Query(f, p="print", q="print", c="call").such_that("Follows", "p", "q").with_("p.varName", "q.varName").such_that("Parent", "_", "c").select("p", "c.procName")), "SELECT DISTINCT x.no AS p, CAST(z.callee AS VARCHAR) AS c_procName FROM sib x JOIN s y ON y.no = x.sibling, s z WHERE x.type = 'print' AND y.type = 'print' AND x.io = y.io AND z.parent IS NOT NULL AND z.callee IS NOT NULL")
add("affects_t_exists", query(lambda f: Query(f, a="assign", b="assign").such_that("Affects*", "a", "b").such_that("Next", "b", "a").boolean()), _AFFECTS_T + " SELECT count(*) > 0 AS holds FROM aft JOIN nx ON nx.l = aft.r AND nx.r = aft.l")


def kept_up(f: Facts) -> StoredClosure:
    """Calls taken in by three batches, by what their callers are, as a log would bring them.  Programs do not recur."""
    edges = f.relation("calls").withColumn("batch", F.pmod(F.xxhash64("l"), F.lit(3)))
    of = lambda k: edges.where(F.col("batch") == k).select("program_id", "l", "r")
    stored = StoredClosure.of(of(0), closure_acyclic)
    stored.add(of(1))
    stored.add(of(2))
    return stored


def without_far_calls(f: Facts) -> DataFrame:
    """The closure that is left when calls over 32 users and more are taken out again."""
    stored = kept_up(f)
    stored.remove(f.relation("calls").where(F.col("r").cast("long") - F.col("l").cast("long") >= 32))
    return stored.pairs.select("l", "r")


def reopened(f: Facts) -> Facts:
    """The facts and two of their relations, saved as a store and opened again."""
    spark, name = f.stmt.sparkSession, f"store_{uuid.uuid4().hex}"
    store.save(f, name, ("next", "parent"), int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shared_folder(spark)}/codeloom/{name}")
    return store.open_store(spark, name)


add("store_next", query(lambda f: Query(reopened(f), a="assign", p="print", v="variable").such_that("Next", "a", "p").such_that("Modifies", "a", "v").such_that("Uses", "p", "v").select("a", "p", "v")), "SELECT x.no AS a, y.no AS p, x.lhs AS v FROM nx JOIN s x ON x.no = nx.l JOIN s y ON y.no = nx.r WHERE x.type = 'assign' AND y.type = 'print' AND x.lhs = y.io")
add("calls_t_incremental", lambda f: kept_up(f).pairs.select("l", "r"), "SELECT CAST(p AS VARCHAR) AS l, CAST(q AS VARCHAR) AS r FROM ct")
add("calls_t_removed", without_far_calls, ", cn AS (SELECT DISTINCT proc AS p, callee AS q FROM s WHERE callee - proc < 32 UNION SELECT cn.p, s.callee FROM cn JOIN s ON s.proc = cn.q WHERE s.callee - s.proc < 32) SELECT CAST(p AS VARCHAR) AS l, CAST(q AS VARCHAR) AS r FROM cn")


def pattern_table(f: Facts) -> DataFrame:
    """Every variable, every constant and, for each constant, a sum with the variable that goes with it: as many patterns as the program has names, met in one join."""
    parts = f.var.select(F.col("var").alias("pattern")).unionByName(f.const.select(F.col("value").alias("pattern")))
    sums = f.const.select(F.concat(F.lit("v"), ((F.col("value").cast("int") * 7 + 3) % 20).cast("string"), F.lit(" + "), "value").alias("pattern"))
    return subtrees.matches(subtrees.index(f), parts.unionByName(sums)).select("pattern", F.col("stmt_no").alias("a"))


add("pattern_table", pattern_table, ", pt AS (SELECT v AS pattern, '(' || v || ')' AS form FROM (SELECT v FROM ud UNION SELECT v FROM md) UNION SELECT CAST(k AS VARCHAR), '(' || k || ')' FROM s UNION SELECT 'v' || ((k * 7 + 3) % 20) || ' + ' || k, '((v' || ((k * 7 + 3) % 20) || ')+(' || k || '))' FROM s) SELECT pattern, no AS a FROM s JOIN pt ON contains(expr, form) WHERE type = 'assign'")

# The nested program of `codeloom.sources.orders`.
_NESTED = """
WITH RECURSIVE rg AS (SELECT CAST(r_regionkey AS BIGINT) * 4 AS no, r_regionkey AS rk, r_name AS proc FROM region),
na AS (SELECT CAST(n_nationkey AS BIGINT) * 4 + 1 AS no, n_nationkey AS nk, rg.no AS parent, lead(CAST(n_nationkey AS BIGINT) * 4 + 1) OVER (PARTITION BY rg.no ORDER BY n_nationkey) AS sibling FROM nation JOIN rg ON rg.rk = n_regionkey),
cu AS (SELECT CAST(c_custkey AS BIGINT) * 4 + 2 AS no, c_custkey AS ck, na.no AS parent, na.parent AS above, lead(CAST(c_custkey AS BIGINT) * 4 + 2) OVER (PARTITION BY na.no ORDER BY c_custkey) AS sibling FROM customer JOIN na ON na.nk = c_nationkey),
od AS (SELECT CAST(o_orderkey AS BIGINT) * 4 + 3 AS no, o_orderkey AS k, cu.no AS parent, cu.parent AS above, cu.above AS top, coalesce(cu.sibling, cu.parent) AS leaves, CASE WHEN o_orderkey % 2 = 0 THEN 'then' ELSE 'else' END AS branch,
       CASE o_orderstatus WHEN 'F' THEN 'assign' WHEN 'O' THEN 'print' ELSE 'read' END AS type, 'v' || (o_orderkey % 20) AS own, 'v' || ((o_orderkey * 7 + 3) % 20) AS used,
       lead(CAST(o_orderkey AS BIGINT) * 4 + 3) OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS sibling FROM orders JOIN cu ON cu.ck = o_custkey),
up AS (SELECT no AS r, parent AS l, 1 AS d FROM na UNION ALL SELECT no, parent, 1 FROM cu UNION ALL SELECT no, above, 2 FROM cu UNION ALL SELECT no, parent, 1 FROM od UNION ALL SELECT no, above, 2 FROM od UNION ALL SELECT no, top, 3 FROM od),
nx AS (SELECT parent AS l, min(no) AS r FROM na GROUP BY parent UNION ALL SELECT no, coalesce(sibling, parent) FROM na
       UNION ALL SELECT parent, min(no) FROM cu GROUP BY parent UNION ALL SELECT no, coalesce(sibling, parent) FROM cu WHERE (SELECT count(DISTINCT od.branch) FROM od WHERE od.parent = cu.no) < 2
       UNION ALL SELECT parent, min(no) FROM od GROUP BY parent, branch UNION ALL SELECT no, coalesce(sibling, leaves) FROM od),
use0 AS (SELECT no, 'v' || (rk % 20) AS v FROM rg UNION ALL SELECT no, 'v' || (nk % 20) FROM na UNION ALL SELECT no, 'v' || (ck % 20) FROM cu UNION ALL SELECT no, CASE WHEN type = 'assign' THEN used ELSE own END FROM od WHERE type <> 'read'),
mod0 AS (SELECT no, own AS v FROM od WHERE type <> 'print'),
af AS (SELECT od.no AS a, od.own AS v, nx.r AS n FROM od JOIN nx ON nx.l = od.no WHERE od.type = 'assign'
       UNION SELECT af.a, af.v, nx.r FROM af JOIN nx ON nx.l = af.n LEFT JOIN mod0 ON mod0.no = af.n AND mod0.v = af.v WHERE mod0.no IS NULL)
"""
#: Name to (builder over the nested program's facts, SQL after the shared tables).
NESTED: dict[str, tuple[Build, str]] = {
    "nested_parent": (pairs("parent"), "SELECT l, r FROM up WHERE d = 1"),
    "nested_parent_t": (pairs("parent_t"), "SELECT l, r FROM up"),
    "nested_follows": (pairs("follows"), "SELECT no AS l, sibling AS r FROM na WHERE sibling IS NOT NULL UNION ALL SELECT no, sibling FROM cu WHERE sibling IS NOT NULL UNION ALL SELECT no, sibling FROM od WHERE sibling IS NOT NULL"),
    "nested_next": (pairs("next"), "SELECT DISTINCT l, r FROM nx"),
    "nested_uses_s": (pairs("uses_s"), "SELECT no AS l, v AS r FROM use0 UNION SELECT up.l, v FROM up JOIN use0 ON use0.no = up.r"),
    "nested_modifies_s": (pairs("modifies_s"), "SELECT no AS l, v AS r FROM mod0 UNION SELECT up.l, v FROM up JOIN mod0 ON mod0.no = up.r"),
    "nested_affects": (pairs("affects"), "SELECT DISTINCT a AS l, n AS r FROM af JOIN od ON od.no = af.n WHERE od.type = 'assign' AND od.used = af.v"),
    # All of a region is one loop.
    "nested_next_t_tested": (query(lambda f: Query(f, a="assign", b="assign", i="if").such_that("Affects", "a", "b").such_that("Parent", "i", "a").such_that("Next*", "b", "i").such_that("Parent*", "i", "b").select("a", "b")), "SELECT DISTINCT af.a, af.n AS b FROM af JOIN od x ON x.no = af.a JOIN od y ON y.no = af.n WHERE y.type = 'assign' AND y.used = af.v AND x.parent = y.parent"),
    "nested_scan_if": (query(lambda f: Query(f, i="if").select("i")), "SELECT no AS i FROM cu"),
    "pattern_if": (query(lambda f: Query(f, i="if").pattern("i", name("v3")).select("i")), "SELECT no AS i FROM cu WHERE ck % 20 = 3"),
    "nested_pattern_if": (query(lambda f: Query(f, i="if", v="variable").pattern("i", "v").select("i", "v")), "SELECT no AS i, 'v' || (ck % 20) AS v FROM cu"),
    "nested_if_in_loop": (query(lambda f: Query(f, w="while", i="if", a="assign").such_that("Parent*", "w", "i").such_that("Parent", "i", "a").pattern("a", name("v3")).select("w", "a")), "SELECT x.l AS w, od.no AS a FROM od JOIN up x ON x.r = od.parent WHERE od.type = 'assign' AND od.own = 'v3'"),
}

#: Queries that mean nothing: an undeclared synonym, an attribute that its entity lacks, an expression that is none.
INVALID: dict[str, tuple[Callable[[Facts], DataFrame], str]] = {
    "semantic_error_bool": (lambda f: Query(f, s="stmt").answer(lambda q: q.such_that("Uses", "_", "s")), "SELECT false AS holds"),
    "semantic_error_tuple": (lambda f: Query(f, w="while", s="stmt").answer(lambda q: q.with_("w.value", 3), "w", "s.stmt#"), "SELECT '' AS w, '' AS s_stmt_no WHERE false"),
    "syntax_error": (lambda f: Query(f, a="assign").answer(lambda q: q.pattern("a", exact="x y"), "a"), "SELECT '' AS a WHERE false"),
}

# Programs of eight users each, written as text and parsed again (`codeloom.sources.texts`).
_TEXTS = _BASE.replace("TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k", "coalesce(TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS INT), 0) AS k").replace(
    "WHEN et = 'purchase' AND k < 10 THEN 'call'",
    "WHEN et = 'purchase' AND k < 10 AND EXISTS (SELECT 1 FROM e u WHERE u.proc = e.proc + (1 << (e.k % 8)) AND u.proc // 8 = e.proc // 8) THEN 'call' WHEN et = 'purchase' AND k < 10 THEN 'print'",
)
_NUMBERS = ", num AS (SELECT no, proc, CAST(proc // 8 AS VARCHAR) AS g, row_number() OVER (PARTITION BY proc // 8 ORDER BY proc, ord) AS n FROM s)"


def numbered(ctes: str, pairs_sql: str) -> str:
    """Pairs of events as pairs of statement numbers in their program."""
    return f"{_TEXTS}{ctes}{_NUMBERS} SELECT x.g AS program_id, x.n AS l, y.n AS r FROM ({pairs_sql}) t JOIN num x ON x.no = t.l JOIN num y ON y.no = t.r"


_FLOW_PAIRS = _FLOW.rindex("SELECT DISTINCT wa.a")
#: Name to (builder over the texts' facts, whole SQL).
TEXTS: dict[str, tuple[Build, str]] = {
    "source_follows": (lambda f: f.relation("follows"), numbered("", "SELECT no AS l, sibling AS r FROM sib WHERE sibling IS NOT NULL")),
    "source_parent_t": (lambda f: f.relation("parent_t"), numbered("", "SELECT parent AS l, no AS r FROM s WHERE parent IS NOT NULL")),
    "source_next_t": (lambda f: f.relation("next_t"), numbered(_NEXT_T, "SELECT l, r FROM nt")),
    "source_affects": (lambda f: f.relation("affects"), numbered("", "SELECT l, r FROM afs")),
    "next_bip": (lambda f: f.relation("next_bip"), numbered(_BIP, "SELECT l, r FROM st WHERE kind = 'call' OR l NOT IN (SELECT no FROM fc)")),
    "next_bip_t": (lambda f: f.relation("next_bip_t"), numbered(_BIP + _WALK, "SELECT DISTINCT a AS l, n AS r FROM wk")),
    "affects_bip": (lambda f: f.relation("affects_bip"), numbered(_BIP + _FLOW[:_FLOW_PAIRS] % "(false)", _FLOW[_FLOW_PAIRS:])),
    "affects_bip_t": (lambda f: f.relation("affects_bip_t"), numbered(_BIP + _FLOW[:_FLOW_PAIRS] % "(false), (true)", _FLOW[_FLOW_PAIRS:])),
    # Programs with a witness, each found in the first part of its procedures that has one.
    "source_affects_t_exists": (
        lambda f: Query(f, a="assign", b="assign").such_that("Affects*", "a", "b").such_that("Next", "b", "a").boolean(),
        _TEXTS + _AFFECTS_T + _NUMBERS + " SELECT n.g AS program_id, coalesce(bool_or(x.hit), false) AS holds FROM num n LEFT JOIN (SELECT DISTINCT aft.l AS no, true AS hit FROM aft JOIN nx ON nx.l = aft.r AND nx.r = aft.l) x USING (no) GROUP BY n.g",
    ),
    "source_pattern": (lambda f: Query(f, a="assign").pattern("a", part="v17").select("a"), _TEXTS + _NUMBERS + " SELECT g AS program_id, n AS a FROM num JOIN s USING (no) WHERE type = 'assign' AND contains(expr, '(v17)')"),
    "source_cross_kind": (
        lambda f: Query(f, p="procedure", v="variable").with_("p.procName", "v.varName").select("p"),
        _TEXTS + " SELECT DISTINCT CAST(a.proc // 8 AS VARCHAR) AS program_id, 'v' || (a.proc % 40) AS p FROM s a JOIN (SELECT proc, v FROM ud UNION SELECT proc, v FROM md) b ON b.proc // 8 = a.proc // 8 AND b.v = 'v' || (a.proc % 40)",
    ),
}

# All users as one program, written as a text in parts and read by lines.
_LINES = _TEXTS.replace(" AND u.proc // 8 = e.proc // 8", "") + ", num AS (SELECT no, row_number() OVER (ORDER BY proc, ord) AS n FROM s)"


def by_line(pairs_sql: str) -> str:
    """Pairs of events as pairs of statement numbers in the one program."""
    return f"{_LINES} SELECT x.n AS l, y.n AS r FROM ({pairs_sql}) t JOIN num x ON x.no = t.l JOIN num y ON y.no = t.r"


#: Name to (builder over the one program's facts, whole SQL).
ONE: dict[str, tuple[Build, str]] = {
    "lines_statements": (
        lambda f: f.stmt.select("stmt_no", "type", "proc", "ord", "last_ord", "parent_no", "callee", "expr_canon"),
        _LINES + " SELECT n AS stmt_no, type, 'u' || proc AS proc, ord, CASE WHEN type = 'while' THEN max(ord) OVER (PARTITION BY proc, loop) ELSE ord END AS last_ord, (SELECT m.n FROM num m WHERE m.no = s.parent) AS parent_no,"
        " 'u' || callee AS callee, CASE WHEN type = 'assign' THEN expr END AS expr_canon FROM s JOIN num USING (no)",
    ),
    "lines_follows": (pairs("follows"), by_line("SELECT no AS l, sibling AS r FROM sib WHERE sibling IS NOT NULL")),
    "lines_next": (pairs("next"), by_line("SELECT l, r FROM nx")),
    "lines_affects": (pairs("affects"), by_line("SELECT l, r FROM afs")),
    "lines_calls_t": (pairs("calls_t"), _LINES + " SELECT 'u' || p AS l, 'u' || q AS r FROM ct"),
    "lines_uses_p": (pairs("uses_p"), _LINES + " SELECT 'u' || p AS l, v AS r FROM up"),
}


def one_program_facts(spark: SparkSession, sf_dir: str) -> Facts:
    """One folder is one program, so a short name does for that of the folder, which every row of every step would carry."""
    lines = read_lines(spark, written_program(spark.read.parquet(f"{sf_dir}/events.parquet")), folders=True)
    return from_programs(lines.withColumn("program_id", F.lit(PROGRAM)))


def events_facts(spark: SparkSession, sf_dir: str) -> Facts:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def orders_facts(spark: SparkSession, sf_dir: str) -> Facts:
    return from_orders(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "orders")])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EVENTS["flow_of_variables"][0](events_facts(spark, sf_dir))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program_texts(spark.read.parquet(f"{sf_dir}/events.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: (lambda spark, sf_dir, b=b: b(events_facts(spark, sf_dir))) for k, (b, _) in EVENTS.items()}
    found |= {k: (lambda spark, sf_dir, b=b: b(from_programs(texts(spark, sf_dir)))) for k, (b, _) in TEXTS.items()}
    found |= {k: (lambda spark, sf_dir, b=b: b(one_program_facts(spark, sf_dir))) for k, (b, _) in ONE.items()}
    found["source_errors"] = lambda spark, sf_dir: parse_errors(faulty_texts(texts(spark, sf_dir)))
    found |= {k: (lambda spark, sf_dir, b=b: b(orders_facts(spark, sf_dir))) for k, (b, _) in NESTED.items()}
    found |= {k: (lambda spark, sf_dir, b=b: b(events_facts(spark, sf_dir))) for k, (b, _) in INVALID.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found = {k: sql if _BASE in sql else _BASE + sql for k, (_, sql) in EVENTS.items()}
    found |= {k: sql for k, (_, sql) in (TEXTS | ONE).items()}
    faults = ", ".join(f"({k}, '{m}')" for k, (_, messages) in FAULTS.items() for m in messages)
    found["source_errors"] = f"SELECT DISTINCT CAST(user_id // 8 AS VARCHAR) AS program_id, message FROM events JOIN (VALUES {faults}) f(k, message) ON k = user_id // 8 % 8"
    found |= {k: _NESTED + sql for k, (_, sql) in NESTED.items()}
    found |= {k: sql for k, (_, sql) in INVALID.items()}
    return found

from riskframe.operators.scripts import script_exports, script_tokens, script_usages

LIB = r"""
// export function commented(a) {}
const text = "export function quoted(a) {}";
/** Sends it. @deprecated use post */
export async function send<T extends Map<string, number>>(url: string, { retries = 3, on: { error = () => null } = {} } = {}, opts?: Map<string, number>, ...rest: any[]) { return helper(url, [1, 2]); }
export const make = async (a = [1, 2], b = f(1, (2, 3)), [x, y] = [], cb = (p, q) => p) => a;
export const total = 3;
export default class Client extends Base {}
module.exports.legacy = function (cb, n = 2) {};
export { helper as aid, total, type Kind };
export function open(a, b
"""


def exports(spark, *files):
    frame = spark.createDataFrame([("lib", p, t) for p, t in files], "repo_id string, path string, text string")
    return {r.name: r for r in script_exports(frame).collect()}


def test_exports_with_brackets_in_parameters(spark):
    got = exports(spark, ("src/index.ts", LIB), ("src/a.test.ts", "export function hidden() {}"), ("x.py", "export function no() {}"))
    assert set(got) == {"lib.send", "lib.make", "lib.Client", "lib.legacy", "lib.aid", "lib.total", "lib.Kind", "lib.open"}
    send = got["lib.send"]
    assert (send.kind, send.line, send.deprecated) == ("function", 5, True)
    assert [(p.name, p.kind, p.default) for p in send.params] == [
        ("url", "pos", None),
        ("{…}", "pos", "{}"),
        ("opts", "pos", "undefined"),
        ("rest", "var", None),
    ]
    assert [(p.name, p.default) for p in got["lib.make"].params] == [
        ("a", "[1, 2]"),
        ("b", "f(1, (2, 3))"),
        ("[…]", "[]"),
        ("cb", "(p, q) => p"),
    ]
    assert got["lib.Client"].kind == "class" and got["lib.Client"].params is None and not got["lib.Client"].deprecated
    assert [p.name for p in got["lib.legacy"].params] == ["cb", "n"]
    assert got["lib.aid"].kind == "export" and got["lib.open"].params is None


def test_first_export_with_parameters_counts(spark):
    got = exports(
        spark,
        ("b.js", "export { run };\nexport function run(a) {}"),
        ("a.js", "export class run {}"),
        ("z.d.ts", "export declare function run(a: string, b?: number): void;"),
    )
    assert len(got) == 1 and got["lib.run"].file == "z.d.ts" and [p.name for p in got["lib.run"].params] == ["a", "b"]
    assert exports(spark, ("a.js", None), ("b.js", "")) == {}


APP = r"""import fetchy, { get as fetch, post } from 'fetchy/client';
import * as ns from "fetchy";
import other from 'other';
const req = require('fetchy');
const { put: send, del } = require("fetchy");
// fetch('in a comment')
fetch('/a', { headers: [1, 2], f(x, y) { return x; } }, (a, b) => a);
post();
ns.get(ns.url(1, 2), post(3,));
req.timeout; obj.fetch(1); function post(a) {}
fetchy('/b'); fetchy.create(
send(`t, ${x}`, "a, b");
"""


def test_call_sites(spark):
    files = spark.createDataFrame([("app", "src/app.ts", APP), ("app", "src/t.d.ts", APP), ("app", "n.js", None)], "repo_id string, path string, text string")
    packages = spark.createDataFrame([("fetchy",), ("unused",)], "library string")
    got = sorted(((r.line, r.usage_kind, r.symbol, r.positional) for r in script_usages(files, packages).collect()), key=repr)
    assert got == sorted([
        (1, "import", "fetchy", None),
        (1, "import", "fetchy.get", None),
        (1, "import", "fetchy.post", None),
        (2, "import", "fetchy", None),
        (4, "import", "fetchy", None),
        (5, "import", "fetchy.put", None),
        (5, "import", "fetchy.del", None),
        (7, "call", "fetchy.get", 3),
        (8, "call", "fetchy.post", 0),
        (9, "call", "fetchy.get", 2),
        (9, "call", "fetchy.url", 2),
        (9, "call", "fetchy.post", 1),
        (10, "reference", "fetchy.timeout", None),
        (11, "call", "fetchy.default", 1),
        (11, "call", "fetchy.create", None),
        (12, "call", "fetchy.put", 2),
    ], key=repr)


def test_token_depths_against_a_plain_scan(spark):
    text = "f(a, [1, {b: (2)}], `x ${(}`) ) // (\n/* ( */ g({"
    rows = script_tokens(spark.createDataFrame([("r", "a.js", text)], "repo_id string, path string, text string")).orderBy("pos").collect()
    stack, want = [], {}
    for r in rows:
        if r.tok in ("(", "[", "{"):
            stack.append(r.pos)
        elif r.tok in (")", "]", "}") and stack:
            want[stack.pop()] = r.pos
    assert {r.pos: r.close for r in rows if r.close is not None} == want and "".join(r.tok for r in rows if r.line == 2) == "g({"


def test_call_sites_move_texts_and_no_tokens(spark):
    text = "import { go } from 'lib';\n) go(1, [2, 3],\n  (4));\nother.go(1); go(go(), ) ] go(1,"
    files = spark.createDataFrame([("r", "a.js", text), ("r", "b.js", "go(1)"), ("r", "c.js", None)], "repo_id string, path string, text string")
    got = script_usages(files, spark.createDataFrame([("lib",)], "library string"))
    rows = sorted((r.file, r.line, r.usage_kind, r.positional) for r in got.collect() if r.positional is not None or r.usage_kind == "import")
    assert rows == [("a.js", 1, "import", None), ("a.js", 2, "call", 3), ("a.js", 4, "call", 0), ("a.js", 4, "call", 1)]
    assert [r.line for r in got.collect() if r.usage_kind == "call" and r.positional is None] == [4]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(repo_id") == 1

"""Taint through expressions and statements, nested templates, and what the lexer tells apart."""

import random

from lumenscan.functions import lexer
from lumenscan.operators import syntax_rules, taint
from lumenscan.plans import flow_queries

#: Programs behind ``const t = req.query.c;`` and how many sinks request data reaches.
CASES = (
    ('let b = (t); db.query(b)', 1),
    ("db.query(('x' + t))", 1),
    ("db.query(`${'x' + t}`)", 1),
    ('let u; if (x) u = t; db.query(u)', 1),
    ('db.query(`a ${`b ${t}`}`)', 1),
    ('db.query(f(t))', 0),
    ('db.query(t || x)', 0),
    ('db.query((t || x))', 0),
    ("db.query('a' + (t ? 1 : 2))", 0),
    ("db.query('a' + (b + (c + ((t)))))", 1),
    ("db.query('a' + (b + !(c + ((t)))))", 0),
    ('let u; for (const k in o) u = t; db.query(u)', 1),
    ('let u, v = t; db.query(v)', 1),
    ('let u; u = v = t; db.query(v)', 1),
    ('let u; u = v = t; db.query(u)', 0),
    ("let u = ''; u += t; db.query(u)", 1),
    ('let u; while (x) { u = t } db.query(u)', 1),
    ('let u; if (x) { } else u = t; db.query(u)', 1),
    ('let f = x => u = t; db.query(u)', 1),
    ('switch (x) { case 1: u = t; break; default: w = t } db.query(u); db.query(w)', 2),
    ('o[query](t)', 1),
    ('(eval)(t)', 1),
    ('db?.query(t)', 1),
    ('db.query(t.a[0].b)', 1),
    ('db.query(t.trim())', 1),
    ('db.query(new X(t))', 0),
    ('db.query(await t)', 0),
    ('db.query(...t)', 0),
    ('db.query([t])', 0),
    ('db.query({a: t})', 0),
    ('db.query(1 + !t)', 0),
    ('db.query(!x + t)', 1),
    ('db.query((a, t))', 0),
    ('lib.sanitize((t)); db.query(t)', 0),
    ('f(`x ${() => { db.query(t) }}`)', 1),
    ('db.query(tag`${t}`)', 0),
    ("db.query(t\n  + 'x')", 1),
    ('var a = b\nvar c = t\ndb.query(c)', 1),
    ('do u = t; while (x)\ndb.query(u)', 1),
    ("db.query('x' in t)", 1),
    ('db.query(a?.b + t)', 1),
    ('db.query(t?.b)', 0),
    ('export const z = t;\ncp.exec(z)', 1),
    ('a\n  .b(t)\n  .query(t)', 1),
)
#: The same without that line.
BARE = (
    ('var x = 1, a = req.query.x; db.query(a)', 1),
    ('const a = (req.query.x), b = ((a)); db.query(b)', 1),
    ('function f(a = req.query.x) { db.query(a) }', 0),
    ('let a = 1,\n  b = req.body.q,\n  c = b;\ncp.exec(c)', 1),
)


def files(spark, texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file_id string, content string")


def test_expressions_and_statements(spark):
    cases = [("const t = req.query.c;\n" + c, n) for c, n in CASES] + list(BARE)
    found = taint.track(syntax_rules.prepare(files(spark, [c for c, _ in cases]))).filter("rule = 'TAINT'").groupBy("file_id").count().collect()
    n = {r["file_id"]: r["count"] for r in found}
    assert [(c, n.get(str(k), 0)) for k, (c, _) in enumerate(cases)] == cases


def test_nestings_of_every_depth(spark):
    """Random wrappers, up to twelve around each other: request data comes through if none of them stops it."""
    rng, texts, through = random.Random(5), [], []
    for _ in range(150):
        around = [rng.choice(flow_queries.AROUND) if rng.random() < 0.3 else rng.choice([a for a in flow_queries.AROUND if a[2]]) for _ in range(rng.randrange(1, 13))]
        e = "t"
        for before, behind, _ in around:
            e = before + e + behind
        texts.append(f"const t = req.query.c;\ndb.query({e});".replace("#{", "${"))
        through.append(all(a[2] for a in around))
    got = {r.file_id for r in taint.track(syntax_rules.prepare(files(spark, texts))).filter("rule = 'TAINT'").collect()}
    assert [t for k, t in enumerate(texts) if (str(k) in got) != through[k]] == []


def shapes(text):
    return [(t.text, t.role or t.kind) for t in lexer.lex(text)]


def test_lexer_templates_keep_places():
    t = lexer.lex("a\n`b ${`c\n${d}`} e`\n'`'")
    assert [(x.text, x.line, x.depth, x.region) for x in t] == [
        ("a", 1, 0, 0), ("`b ${`c\n${d}`} e`", 2, 0, 0), ("${", 2, 0, 0), ("`c\n${d}`", 2, 1, 3), ("${", 3, 1, 3), ("d", 3, 2, 5), ("}", 3, 1, 3), ("}", 3, 0, 0), ("'`'", 4, 0, 0)]
    assert t[1].chunks == ["b ", " e"] and t[3].chunks == ["c\n", ""] and t[1].close == 8


def test_lexer_tells_brackets_and_patterns():
    assert [r for x, r in shapes("f(a)[0] = (b) + [c]; if (d) { } function g(h) { } (i) => { }; k(l) { }") if x in "([{"] == ["call", "index", "group", "array", "head", "block", "params", "block", "params", "block", "params", "block"]
    assert [x for x, r in shapes("a / b / c; x = /d[/]e/g; if (y) /f/.test(z); (w) / 2 / v") if r == "regex"] == ["/d[/]e/g", "/f/"]
    for bad in ("f((1);", "a ] b", "`x ${ y", "`x", "'x", "/* x", "`${ ( }`", "}"):
        assert any(r == "error" for _, r in shapes(bad)), bad
    for good in ("", "`${{a: `}`}}`", "x = {a: {b: [1, (2)]}}", "'it\\'s'", "a = b /* c */ // d", "`\\` ${'`'} $`"):
        assert not any(r == "error" for _, r in shapes(good)), good
    assert lexer.lex(None) == []


def test_lexer_takes_long_and_deep_texts():
    deep = "(" * 3000 + "x" + ")" * 3000
    t = lexer.lex(deep)
    assert len(t) == 6001 and t[0].close == 6001 and t[0].core == 3000 and t[0].sole == ["x"]
    nested = "x"
    for _ in range(400):
        nested = "`${" + nested + "}`"
    assert not any(x.kind == "error" for x in lexer.lex(nested))


BROKEN = ("const = 3;", "f(,)", "x y z", "a = ;", "b = c +;", "return (a &&);", "f(a, b +)", "let x = 1 2;", "'a' 'b'", "f(=)", "if (a ==) { }", "q = [1, 2 +];", "o.;", "x = => 1;", "g(a b)")
SOUND = (
    "", "a = b\nc = d", "x = -1 + +y - -z; i++; --j;", "for (const k of o) f(k); for (const k in o) g(k);", "async function* f() { yield* g(); await h }", "import a, { b as c } from './x'; export * from './y'; export default d;",
    "class A extends B { static async m() { } get p() { return 1 } #q = 2; *gen() { } }", "const { a, b: [c, , d], ...e } = f, g = [, 1];", "type T = A | B; let x: string = y as any; function f<T>(a?: T, b: Array<T>): Promise<void> { return z! }",
    "if (a) b(); else c(); do d(); while (e); switch (f) { case 'g': h(); break; default: i() }", "label: for (;;) { continue label; }", "x = a ? b : c; y = (d, e); z = f ?? g; w = h?.i?.[j]?.(k);", "const t = `a ${b} c`, u = tag`x`;", "'use strict'\n'other'\nf()",
    "x = /a b/g.test(c) && typeof d === 'e';", "const el = <div className='a'>Hello world it is {x}</div>;", "var a = .5 + 1.;", "new Foo; throw new Error('x'); delete a.b; void 0;", "a => b; (c, d) => { }; async e => f;", "@dec() class G { @prop() h; }", "f(a,)\n[b, ].c", "let async; let of = 1; x = {get: 1, set, static: 2};")


def test_statements_that_cannot_be_read(spark):
    for texts, bad in ((BROKEN, True), (SOUND, False), (tuple(c for c, _ in BARE) + tuple(c for c, _ in CASES), False)):
        p = syntax_rules.prepare(files(spark, texts))
        got = {r.file_id: r.error for r in syntax_rules.errors(p).collect()}
        assert [(t, got.get(str(k))) for k, t in enumerate(texts) if (str(k) in got) != bad] == []


def test_callees_in_brackets(spark):
    programs = ["var q = req.query.a; o[exec](q);", "var q = req.query.a; eval((q));", "(eval)(q);", "o?.[exec](q);", "child_process[exec]('ls');", "f(`a ${eval(x)}`);"]
    got = syntax_rules.scan(syntax_rules.prepare(files(spark, programs))).filter("rule_id IN ('EVAL', 'EXEC')").collect()
    assert sorted((r.file_id, r.message) for r in got) == [
        ("0", "Request data reaches a process call"), ("1", "Request data reaches eval"), ("2", "eval runs text as code"), ("4", "Process call with a command line"), ("5", "eval runs text as code")]


def test_a_chain_of_two_hundred_files_in_few_rounds(spark, monkeypatch):
    rounds = []
    least = taint._least
    monkeypatch.setattr(taint, "_least", lambda paths, *keys: rounds.append(keys) or least(paths, *keys))
    n = 200
    rows = [("0", "src/m0.js", "import { f } from './m1';\nconst a = req.query.x;\nf(a);")]
    rows += [(str(k), f"src/m{k}.js", f"import {{ f as g }} from './m{k + 1}';\nfunction f(p) {{ g(p); }}") for k in range(1, n)]
    rows += [(str(n), f"src/m{n}.js", "function f(p) { db.query(p); }")]
    got = taint.track(syntax_rules.prepare(spark.createDataFrame(rows, "file_id string, path string, content string"))).collect()
    assert [(r.file_id, r.rule, r.round, r.origin_file, len(r.flow)) for r in got] == [(str(n), "TAINT", n, "0", n + 1)]
    assert [x.split(":")[0] for x in got[0].flow] == [f"m{k}.js" for k in range(n + 1)]
    assert sum(k == ("origin", "node") for k in rounds) - 1 <= 10


def test_closure_against_brute_force(spark, tmp_path):
    from lumenscan.functions import scratch

    rng = random.Random(9)
    for case in range(3):
        nodes = 25
        edges = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(45)}
        start = {(o, rng.randrange(nodes)) for o in range(6)}
        e = spark.createDataFrame([(str(a), str(b), [f"e{a}-{b}"]) for a, b in edges], "node string, next string, flow array<string>")
        s = spark.createDataFrame([(str(o), str(a), [f"s{o}"]) for o, a in start], "origin string, node string, flow array<string>")
        got = {(r.origin, r.node): (r.steps, list(r.flow)) for r in taint.closure(s, e, lambda t, name: scratch.write(t, f"file://{tmp_path}/{case}/{name}")).collect()}
        want = {}
        for o, a in start:
            front = {a: [f"s{o}"]}
            seen, steps = {}, 1
            while front:
                seen.update({n: (steps, f) for n, f in front.items()})
                near = {}
                for x, f in front.items():
                    for a, b in edges:
                        if a == x and b not in seen:
                            near[b] = min(near.get(b, ["~"]), [*f, f"e{a}-{b}"])
                front, steps = near, steps + 1
            want |= {(str(o), str(n)): v for n, v in seen.items()}
        assert got == want

"""Rules on a labelled corpus of snippets, and flows across files."""

from pyspark.sql import functions as F

from quern.plans import catalogue, rules

POSITIVE = [
    ("py-code-injection-eval", "a.py", "def f(x):\n    return eval(x)\n"), ("py-command-injection-shell-true", "b.py", "import subprocess\nsubprocess.run(cmd, shell=True)\n"), ("py-weak-crypto-hash", "c.py", "h = hashlib.md5(data)\n"), ("py-insecure-deserialization", "d.py", "x = pickle.loads(b)\n"),
    ("py-tls-validation-disabled", "e.py", "requests.get(u, verify=False)\n"), ("py-insecure-random-context", "f.py", "def make_token():\n    return random.choice(s)\n"), ("py-error-swallowed-except", "g.py", "try:\n    f()\nexcept E:\n    pass\n"), ("py-fail-open-except", "h.py", "def check_access(u):\n    try:\n        g(u)\n    except E:\n        return True\n"),
    ("py-debug-mode-enabled", "i.py", "app.run(debug=True)\n"), ("py-bind-all-interfaces", "j.py", "s.bind((\"0.0.0.0\", 80))\nrun(\"0.0.0.0\")\n"), ("py-unsafe-reflection-dynamic", "k.py", "getattr(o, name)\n"), ("js-xss-inner-html", "a.js", "el.innerHTML = x;\n"), ("js-code-injection-eval", "b.js", "eval(x);\n"), ("js-weak-crypto-hash", "c.js", "crypto.createHash('md5');\n"),
    ("js-error-swallowed-catch", "d.js", "try { f(); } catch (e) { }\n"), ("js-insecure-cookie-flag", "e.js", "res.cookie('a', b, { secure: false });\n"), ("java-weak-crypto-hash", "A.java", "class A { void f() { MessageDigest.getInstance(\"MD5\"); } }\n"), ("java-weak-crypto-cipher", "B.java", "class B { void f() { Cipher.getInstance(\"DES\"); } }\n"), ("java-insecure-deserialization", "C.java", "class C { void f() { new ObjectInputStream(in); } }\n"),
    ("java-xxe-unhardened-parser", "D.java", "class D { void f() { DocumentBuilderFactory.newInstance(); } }\n"), ("go-weak-crypto-hash", "a.go", "func f() { md5.New() }\n"), ("go-tls-validation-disabled", "b.go", "func f() { c := &tls.Config{InsecureSkipVerify: true} }\n"), ("rust-unsafe-code-block", "a.rs", "fn f() { unsafe { g() } }\n"), ("rust-uncaught-panic-unwrap", "b.rs", "fn f() { x.unwrap(); }\n"), ("rust-weak-crypto-hash", "c.rs", "fn f() { let h = Md5::new(); }\n"),
    ("c-dangerous-function-gets", "a.c", "void f() { gets(b); }\n"), ("c-buffer-overflow-unbounded-copy", "b.c", "void f() { strcpy(a, b); }\n"), ("c-format-string-variable", "c.c", "void f() { printf(s); }\n"), ("cs-weak-crypto-hash", "A.cs", "class A { void F() { MD5.Create(); } }\n"), ("cs-insecure-deserialization", "B.cs", "class B { void F() { new BinaryFormatter(); } }\n"), ("kotlin-weak-crypto-hash", "a.kt", "fun f() { MessageDigest.getInstance(\"MD5\") }\n"),
    ("any-suspicious-security-line-comment", "l.py", "# TODO: validate the password here\n"), ("py-secret-in-log", "m.py", "logger.info(user_password)\n"), ("py-sql-dynamic-construction", "n.py", "cur.execute(\"select a from t where x = \" + y)\n"),
]
SAFE = [
    ("a.py", "def f(x):\n    return ast.literal_eval(x)\n"), ("b.py", "subprocess.run([\"ls\"], shell=False)\n"), ("c.py", "h = hashlib.sha256(data)\nk = hashlib.md5(data, usedforsecurity=False)\n"), ("d.py", "x = json.loads(b)\ny = yaml.load(b, Loader=SafeLoader)\n"), ("e.py", "requests.get(u, verify=True)\n"), ("f.py", "def pick_colour():\n    return random.choice(s)\n"),
    ("g.py", "try:\n    f()\nexcept E:\n    log(e)\n"), ("a.js", "el.textContent = x;\ncrypto.createHash('sha256');\n"), ("A.java", "class A { void f() { MessageDigest.getInstance(\"SHA-256\"); } }\n"), ("a.go", "func f() { sha256.New() }\n"), ("a.rs", "fn f() { g(); }\n"), ("a.c", "void f() { printf(\"%d\", x); fgets(b, 3, f); }\n"), ("n.py", "cur.execute(\"select a from t where x = ?\", (y,))\n"), ("k.py", "getattr(o, \"name\")\n"),
]


def table(spark, rows):
    from quern.sources.files import language_of

    return spark.createDataFrame(rows, "rel_path string, content string").withColumn("language", language_of(F.col("rel_path")))


def test_catalogue_is_whole():
    ids = {r[0] for r in catalogue.RULES}
    assert len(ids) == 115 and all(catalogue.meta(i) for i in ids)
    assert len({f"{a}-{rules.KEY_NAMES[k]}" for a in rules.CALLS for k in rules.SINKS if (a, k) not in rules.LACKING}) == 45


def test_structural_rules_fire_and_stay_silent(spark):
    hit = {(r["rule"], r["file"]) for r in rules.structural(table(spark, [(f"src/{p}", s) for _, p, s in POSITIVE])).collect()}
    missing = [(rule, p) for rule, p, _ in POSITIVE if (rule, f"src/{p}") not in hit]
    assert not missing
    silent = rules.structural(table(spark, [(f"src/{p}", s) for p, s in SAFE])).collect()
    assert not [(r["rule"], r["file"]) for r in silent]


def test_flows_across_files(spark):
    files = [("runner.py", "import os\ndef launch(cmd):\n    os.system(cmd)\n"), ("app.py", "from runner import launch\ndef view():\n    q = request.args['q']\n    launch(q)\n"), ("safe.py", "def view2():\n    n = int(request.args['n'])\n    launch(n)\n"), ("sql.py", "def view3(cur):\n    name = request.form['n']\n    cur.execute(f\"select a from t where n = '{name}'\")\n")]
    got = {(r["rule"], r["file"], r["line"]) for r in rules.taint(table(spark, files)).collect()}
    assert got == {("py-command-injection-taint", "app.py", 4), ("py-sql-injection-taint", "sql.py", 3)}
    twice = rules.taint(table(spark, [*files[:2], ("other.py", "def launch(cmd):\n    os.system(cmd)\n")])).collect()
    assert not twice


MORE = {
    "m.java": "class A { void f(HttpServletRequest request, Statement st) {\n StringBuilder sb = new StringBuilder();\n sb.append(request.getParameter(\"q\"));\n st.executeQuery(sb.toString()); } }\n",
    "places.py": "def a(c):\n    d['k'] = request.args['q']\n    c.execute('x' + d['k'])\ndef b(c):\n    x, y = request.args['q'], 1\n    c.execute(y)\n    c.execute(x)\n",
    "guards.py": "def g(name):\n    open(request.args['p'])\n    if name.startswith('a'):\n        pass\ndef h():\n    p, r = request.args['p'], request.args['r']\n    if not p.startswith('/a'):\n        return\n    open(p)\n    open(r)\ndef i():\n    p = request.args['p']\n    log(p.startswith('/a'))\n    open(p)\n",
    "fields.py": "class X:\n    def one(self):\n        self.q = request.args['q']\n        c.execute(self.q)\n    def two(self):\n        c.execute(self.q)\n    def three(self):\n        self.q = 'a'\n        c.execute(self.q)\n",
    "same.py": "class A:\n    def run(self):\n        q = request.args['q']\n        print(q)\nclass B:\n    def run(self, cur, q):\n        cur.execute(q)\n",
    "chain.py": "def f1(a):\n    f2(a)\ndef f2(b):\n    f3(b)\ndef f3(c):\n    f4(c)\ndef f4(d):\n    f5(d)\ndef f5(e):\n    f6(e)\ndef f6(g):\n    os.system(g)\ndef go():\n    f1(request.args['q'])\n",
    "tail.rs": "fn given(req: Request) -> String {\n    req.query(\"q\")\n}\nfn same(x: String) -> String { format!(\"a {x}\") }\nfn other(x: String) -> String { let a = x; \"b\".to_string() }\nfn run(c: Conn) {\n    let s = same(given());\n    sqlx::query(&s);\n    let t = other(given());\n    sqlx::query(&t);\n}\n",
    "parts.js": "function v(req, res) { const {q} = req.query;\n db.query('s' + q);\n const n = Number(q);\n db.query('s' + n);\n for (const x of req.body) {\n db.query(x); } }\n",
    "deep.py": "def z(c):\n    q = request.args['q']\n    c.execute(" + "f(" * 40 + "q" + ")" * 40 + ")\n    c.execute(" + "f(" * 20 + "int(q)" + ")" * 20 + ")\n",
}


def test_flows_through_changes_places_guards_fields_and_returns(spark):
    got = {(r["file"], r["line"], r["flow"]["source_line"], r["function"]) for r in rules.taint(table(spark, list(MORE.items()))).collect()}
    assert got == {
        ("m.java", 4, 3, "f"), ("places.py", 3, 2, "a"), ("places.py", 7, 5, "b"), ("guards.py", 2, 2, "g"), ("guards.py", 10, 6, "h"), ("guards.py", 14, 12, "i"), ("fields.py", 4, 3, "one"), ("fields.py", 6, 3, "two"),
        ("chain.py", 14, 14, "go"), ("tail.rs", 8, 7, "run"), ("parts.js", 2, 1, "v"), ("parts.js", 6, 5, "v"), ("deep.py", 3, 2, "z"),
    }


def test_extraction_is_linear_in_the_file():
    import time

    from quern.operators import dataflow

    def took(text):
        began = time.process_time()
        dataflow.found(text, "python")
        return time.process_time() - began

    many = "def f{0}(a):\n    b = a + {0}\n    return g(b)\n\n"
    took("".join(many.format(k) for k in range(200)))
    assert took("".join(many.format(k) for k in range(4000))) < 25 * max(took("".join(many.format(k) for k in range(500))), 0.01)
    assert took("x = " + "f(" * 20000 + "q" + ")" * 20000) < 25 * max(took("x = " + "f(" * 2500 + "q" + ")" * 2500), 0.01)


def test_rules_meet_facts_by_their_words(spark):
    from quern.operators import source

    files = table(spark, [(f"src/{p}", s) for _, p, s in POSITIVE] + [(f"ok/{p}", s) for p, s in SAFE])
    facts = rules.facts(files, source.analysis(files)).persist()
    every = facts.count() * len(catalogue.RULES)
    assert rules.candidates(facts).count() * 50 < every
    for rule, _, _, exprs, _ in catalogue.RULES:  # a text that fits an expression holds one of its words
        for e in exprs.values():
            words = None if e.startswith("!") else rules.required_words(e)
            assert words is None or all(w == w.lower() and w for w in words)
    assert rules.required_words(r"^(md5|md4|sha1)$") == {"md5", "md4", "sha1"} and rules.required_words(r"\bunsafe\s*\{") == {"unsafe"}
    assert rules.required_words(r"innerHTML") is None and rules.required_words(r"(^|\.)DEBUG$") is None and rules.required_words(r"^.*$") is None and rules.required_words(r"x?eval\(") is None


def test_gates_look_at_the_function_around(spark):
    text = "class X {\n void f() {\n  q = DocumentBuilderFactory.newInstance();\n  q.setFeature(\"external-general-entities\", false); }\n}\nclass Y {\n void f() {\n  q = DocumentBuilderFactory.newInstance(); }\n}\n"
    got = [(r["rule"], r["line"]) for r in rules.structural(table(spark, [("a.java", text)])).collect()]
    assert got == [("java-xxe-unhardened-parser", 8)]


def test_audit_drops_structural_twins(spark):
    files = table(spark, [("app.py", "def view(cur):\n    name = request.form['n']\n    cur.execute(\"select a from t where n = \" + name)\n")])
    got = [r["rule"] for r in rules.audit(files).collect()]
    assert got == ["py-sql-injection-taint"]


def test_rules_meet_files_in_one_pass_as_they_do_by_joins(spark):
    odd = [("crlf.py", "def make_token():\r\n    eval(x)\r\n    return random.choice(s)\r\n\r\n"), ("one.js", "function a() { function token() { k = Math.random(); } eval(x) } try { a() } catch (e) { }"), ("empty.py", ""), ("none.py", None), ("a.txt", "eval(x)")]
    hardened = [("two.java", "class X {\n void f() {\n  q = DocumentBuilderFactory.newInstance();\n  q.setFeature(\"external-general-entities\", false); }\n}\nclass Y {\n void f() {\n  q = DocumentBuilderFactory.newInstance(); }\n}\n")]
    files = table(spark, [(f"src/{p}", s) for _, p, s in POSITIVE] + [(f"ok/{p}", s) for p, s in SAFE] + list(MORE.items()) + odd + hardened)
    once, joined = rules.structural(files), rules.structural(files, rules.parsed(files))
    assert once.count() > len(POSITIVE) and once.exceptAll(joined).count() == 0 == joined.exceptAll(once).count()


def test_parts_that_an_expression_needs():
    assert rules.required_parts(r"CipherMode\.ECB") == {"ciphermode.ecb"} and rules.required_parts(r"(?s)(?=.*a\()(?=.*(Allow|Let)All\(\))") == {"allowall()", "letall()"}
    assert rules.required_parts(r"(x.*abc|y\d+de)z?") == {"abc", "de"} and rules.required_parts(r"(?i)\w*(Pass(wor)?d)+\s*==") == {"passd", "password"}
    assert rules.required_parts(r"(?!abc)\w*") is None and rules.required_parts(r"(abc)?\d") is None and rules.required_parts(r"(abc|\d+)") is None

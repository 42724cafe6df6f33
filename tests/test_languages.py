import time

from pyspark.sql import functions as F

from sextant.functions import paths as P
from sextant.functions.source_text import script_profile
from sextant.operators import modules


def facts_of(spark, path, content):
    df = spark.createDataFrame([(path, content)], "path string, content string")
    return modules.with_facts(df.withColumn("language", P.language(F.col("path")))).first()


def edges_of(spark, files, go_module=None):
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    units = modules.with_facts(df.withColumn("language", P.language(F.col("path"))))
    return sorted(tuple(r) for r in modules.resolve(units, go_module).written_out().collect())


def targets_of(spark, src, spec, known, go_module=None):
    rows = [(src, [spec])] + [(path, []) for path in known if path != src]
    units = spark.createDataFrame(rows, "path string, specifiers array<string>")
    units = units.withColumn("language", P.language(F.col("path")))
    found = modules.resolve(units, go_module).written_out().where(F.col("src") == src)
    return sorted(row["dst"] for row in found.collect())


def test_path_predicates(spark):
    cases = {
        "lib/ink.mts": ("typescript", True, False), "lib/ink.cjs": ("typescript", True, False),
        "press/roll.py": ("python", True, False), "press/roll_test.py": ("python", True, True),
        "press/test_roll.py": ("python", True, True), "type/set.go": ("go", True, False),
        "type/set_test.go": ("go", True, True), "type/set.rs": ("rust", True, False),
        "tests/set.rs": ("rust", True, True), "lib/ink.spec.ts": ("typescript", True, True),
        "lib/ink.d.ts": ("typescript", False, False), "press/roll.txt": (None, False, False),
    }
    df = spark.createDataFrame([(path,) for path in cases], "path string")
    p = F.col("path")
    rows = df.select(p, P.language(p), P.is_source_path(p), P.is_test_path(p)).collect()
    assert {row[0]: tuple(row)[1:] for row in rows} == cases


def test_candidates(spark):
    cases = {
        "lib/ink.ts": True, "/lib/ink.ts": False, "lib/../ink.ts": False, "lib/ink.min.js": False,
        "lib/ink.pb.go": False, "lib/ink_pb2.py": False, "node_modules/ink/ink.ts": False,
        ".cache/ink.ts": False, "lib/build/ink.js": False, "lib/builder/ink.js": True, "ink.csv": False,
    }
    df = spark.createDataFrame([(path,) for path in cases], "path string")
    rows = df.select("path", P.is_candidate(F.col("path"))).collect()
    assert {row[0]: row[1] for row in rows} == cases


PRESS = {
    "app/main.py": "import os, json as j\nfrom press.roll import ink\nfrom . import plate\n"
    "async def run(): pass\nclass _Hidden: pass\nclass Shown: pass\n",
    "app/plate.py": "", "press/roll.py": "from .feed import paper\n", "press/feed.py": "",
    "press/__init__.py": "",
    "go/set/a.go": 'package set\nimport (\n"fmt"\n"example.org/type/go/ink"\n)\nfunc Lay() {}\ntype\nX int\n',
    "go/ink/b.go": "package ink\nconst Black = 1\n", "go/ink/c.go": "package ink\n",
    "go/ink/c_test.go": "package ink\n",
    "crate/src/main.rs": "mod bed;\nuse crate::bed::{Slide, frame as f};\npub async fn go() {}\n",
    "crate/src/bed.rs": "pub struct Slide;\n", "crate/src/bed/frame.rs": "",
    "web/page.ts": "import a from './part';\nimport type { T } from './kinds.js';\n"
    "export { b } from './part';\nexport const c = 1, d = 2;\n",
    "web/part/index.ts": "export default 1;\n", "web/kinds.ts": "export interface T {}\n",
}


def test_facts_of_each_language(spark):
    main = facts_of(spark, "app/main.py", PRESS["app/main.py"])
    assert main["specifiers"] == ["os", "json", "press.roll", ".plate"] and main["exports"] == ["Shown", "run"]
    go = facts_of(spark, "go/set/a.go", PRESS["go/set/a.go"])
    assert go["specifiers"] == ["fmt", "example.org/type/go/ink"] and go["exports"] == ["Lay"]
    rust = facts_of(spark, "crate/src/main.rs", PRESS["crate/src/main.rs"])
    assert set(rust["specifiers"]) == {"mod:bed", "crate::bed::Slide", "crate::bed::frame"}
    assert rust["exports"] == ["go"]
    page = facts_of(spark, "web/page.ts", PRESS["web/page.ts"])
    assert page["specifiers"] == ["./part"] and page["type_imports"] == 1 and "c" in page["exports"]
    assert facts_of(spark, "app/none.py", None)["specifiers"] in ([], None)


def test_edges_of_each_language(spark):
    assert edges_of(spark, PRESS, "example.org/type") == [
        ("app/main.py", "app/plate.py"), ("app/main.py", "press/roll.py"),
        ("crate/src/main.rs", "crate/src/bed.rs"), ("crate/src/main.rs", "crate/src/bed/frame.rs"),
        ("go/set/a.go", "go/ink/b.go"), ("go/set/a.go", "go/ink/c.go"), ("press/roll.py", "press/feed.py"),
        ("web/page.ts", "web/part/index.ts"),
    ]
    assert targets_of(spark, "web/x.ts", "./ink.js", ["web/ink.js", "web/ink.ts"]) == ["web/ink.js"]
    assert targets_of(spark, "web/x.ts", "ink", ["web/ink.ts"]) == []


def test_script_profile():
    source = "function f(a) {\n  if (a && a.b) {\n    for (const x of a) g(x);\n  }\n}\nconst h = () => (1 ? 2 : 3);\n"
    assert script_profile(source)[0] == 2 and script_profile(source)[4] == 5
    assert script_profile("}{") == (0, 0, 0, 0, 0)


def test_long_comments_take_linear_time(spark):
    blank = "/*" + " ink on paper\n" * 5000 + "*/\nimport a from './b';\nexport const c = 1;\n"
    for path in ("web/x.ts", "type/x.rs", "type/x.go"):
        start = time.perf_counter()
        facts_of(spark, path, blank)
        assert time.perf_counter() - start < 20  # quadratic patterns took minutes

"""Files of two states against all pairs, and reviews under changed names."""

import random
from collections import Counter

import yaml

from provena.operators import versions
from provena.plans.validate import validate

from . import toy

SHAPE = "file string, text string"


def likeness(a, b):
    x, y = (Counter(t.split("\n")) for t in (a, b))
    size = lambda c: sum(n * (len(line.encode()) + 1) for line, n in c.items())
    return size(x & y), max(size(x), size(y))


def test_alike_by_all_pairs(spark):
    r = random.Random(3)
    words = [f"line {k} é" for k in range(60)]
    text = lambda: "\n".join(["every file has this line"] * r.randint(1, 3) + r.choices(words, k=r.randint(1, 12)))
    old = [(f"o{k}", text()) for k in range(60)]
    new = [(f"n{k}", r.choice(old)[1] if k % 3 else text()) for k in range(40)]
    new = [(f, "\n".join(line if r.random() < 0.8 else r.choice(words) for line in t.split("\n"))) for f, t in new] + [("empty", "")]
    got = {(x.file, x.before): (x.shared, x.size) for x in versions.alike(spark.createDataFrame(new, SHAPE), spark.createDataFrame(old, SHAPE)).collect()}
    want = {(f, g): likeness(a, b) for f, a in new for g, b in old}
    assert got == {k: v for k, v in want.items() if 2 * v[0] >= v[1]} and len(got) > 30


def test_renamed(spark):
    body = lambda k, changed=0: "\n".join(["kept everywhere"] + [f"{'new' if n < changed else 'own'} line {n} of {k}" for n in range(10)])
    before = [("a", body("a")), ("b", body("b")), ("c", body("c")), ("d", body("d")), ("e", body("x")), ("f", body("x")), ("g", "")]
    now = [("a", "wholly other"), ("b2", body("b")), ("c2", body("c", 3)), ("c3", body("c", 4)), ("d2", body("d", 8)), ("x1", body("x")), ("x2", body("x")), ("x3", body("x")), ("g", "")]
    got = {r.file: r.before for r in versions.renamed(spark.createDataFrame(now, SHAPE), spark.createDataFrame(before, SHAPE)).collect()}
    assert got == {"a": "a", "b2": "b", "c2": "c", "c3": None, "d2": None, "x1": "e", "x2": "f", "x3": None, "g": "g"}


def test_a_changed_entry_under_another_name_needs_a_new_review(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "new").mkdir()
    toy.write(tmp_path / "old", [toy.entry(tmp_path / "old")])

    def issues(change, name="renamed"):
        doc = toy.entry(tmp_path / "new") | {"id": name}
        change(doc)
        root = toy.write(tmp_path / "new", [doc])
        for p in (root / "registry").glob("*.yaml"):
            if p.stem != name:
                p.unlink()
        return {(r.code, r.model) for r in validate(spark, root, today="2026-10-01", since=tmp_path / "old").collect()}

    caveat = lambda d: d["corpora"][0]["result"]["caveats"].append("another one")
    assert ("G03", "renamed") in issues(caveat) and ("G03", "north") in issues(caveat, "north")
    assert not any(code == "G03" for code, _ in issues(lambda d: None))  # another name alone isn't a change

    def signed(doc):
        caveat(doc)
        doc["review"]["date"] = "2026-09-01"

    assert not any(code == "G03" for code, _ in issues(signed))
    assert yaml.safe_load((tmp_path / "new/registry/renamed.yaml").read_text())["id"] == "renamed"

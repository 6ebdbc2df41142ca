from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.functions.canonical import canonical_sha256
from kgspark.functions.phonetic import metaphone


def apply(spark, values, *fns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = df.select("i", *[f(F.col("x")).alias(f"c{n}") for n, f in enumerate(fns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(fns) > 1 else r[1] for r in rows]


def test_names(spark):
    got = apply(spark, ["  Herring_Monitoring ", "@TypePrefix", "Some-Thing", "  double  space  ", "a   b"], X.normalize_name)
    assert got == ["herring monitoring", "typeprefix", "some thing", "double space", "a  b"]
    assert apply(spark, ["[[People/John Smith|John]]", "[[Organizations/DFO]]", "plain text"], X.normalize_alias) == ["john smith", "dfo", "plain text"]


def test_links_and_values(spark):
    got = apply(spark, ["[[Organizations/River Net]]", "[[People/Ann Lee|Ann]]", "[[River Net]]", "organizations/open-civics", '"River Net"', ""], X.link_name, X.link_type)
    assert got == [("River Net", "Organization"), ("Ann Lee", "Person"), ("River Net", None), ("open civics", "Organization"), ("River Net", None), ("", None)]
    assert apply(spark, ["a, b,,c ", "[[a]], [[b|c]]", "one", None], X.split_values) == [["a", "b", "c"], ["[[a]]", "[[b|c]]"], ["one"], []]


def test_identifiers(spark):
    rid = "orn:koi-net.practice:foo+abc"
    assert apply(spark, [rid, "orn:entity:concept/bar+def", "unknown-format"], X.rid_type) == ["Practice", "Concept", None]
    assert apply(spark, ["Casestudy", "nothing"], X.canonical_type) == ["CaseStudy", None]
    assert apply(spark, ["https://u@a.b:80/x?y"], X.web_rid)[0].startswith("orn:web.page:u@a_b_80/")
    assert apply(spark, ["https://github.com/o/r.git", "git@github.com:o/r", "https://x.org/a/b.git"], X.repo_name) == ["o/r", "o/r", "b"]
    assert apply(spark, ["http://127.0.0.1/", "https://a.org/x", "ftp://a.org", "http://172.20.1.1/", "http://localhost:8080"], X.public_url) == [False, True, False, False, False]
    assert apply(spark, ["2024-01-01T00:00:00+00:00"], X.zulu) == ["2024-01-01T00:00:00Z"]


def test_paths(spark):
    got = apply(spark, ["vault:notes/Meetings/2024-05-06 talk.md", "orn:obsidian.entity:Notes/a.md", "vault:x/2024.md", "web:q"], X.note_path, lambda c: X.note_date(X.note_path(c)))
    assert got == [("Meetings/2024-05-06 talk", "2024-05-06"), ("a", None), ("x/2024", None), ("web:q", None)]
    assert apply(spark, ["github:o/r:docs/a.md", "github:o/r:a.py", "vault:People/A B.md", "web:x"], X.hit_slug) == ["docs/a", None, "People/A-B", None]


def test_words_and_tokens(spark):
    assert apply(spark, [" a b\n c ", "", "  "], X.words) == [["a", "b", "c"], [], []]
    assert apply(spark, ["the dr smith", "the", ""], lambda c: X.significant_token(c, ["the", "dr"])) == ["smith", "the", ""]
    assert apply(spark, ["Sean", "rhys", "Bob"], X.fold_phonetic) == ["shawn", "reese", "bob"]


def test_backoff(spark):
    assert apply(spark, ["1", "2", "9"], lambda c: X.backoff_seconds(c.cast("int"))) == [30.0, 60.0, 600.0]


def test_canonical_hash(spark):
    text = '{"@type":"bkc:Practice","name":"Herring Monitoring","score":1.0,"tags":["marine","monitoring"],"nested":{"b":2,"a":1}}'
    turned = '{"nested":{"a":1,"b":2},"tags":["marine","monitoring"],"score":1,"name":"Herring Monitoring","@type":"bkc:Practice"}'
    want = "5ca5beab92e32909ebf181d674f58e74d18858ea78ef1e33b40ffdbafa9db4c8"
    got = apply(spark, [text, turned, '{"score":1.0}', "no json"], canonical_sha256)
    assert got[:2] == [want, want] and got[3] is None
    assert got[2] != "4a0efab20925fd0974dc33fca675fbb5bca3c0138daee2f824241ef89e0a9a18"


def test_phonetic_codes():
    known = {"Smith": ("SM0", "XMT"), "Schmidt": ("XMT", "SMT"), "Thomas": ("TMS", "TMS"), "Catherine": ("K0RN", "KTRN"), "Knight": ("NT", "NT"),
             "Philip": ("FLP", "FLP"), "Jose": ("HS", "HS"), "Xavier": ("SF", "SFR"), "Shawn": ("XN", "XN"), "Michael": ("MKL", "MXL"), "Caesar": ("SSR", "SSR"),
             "Wright": ("RT", "RT"), "Paul": ("PL", "PL"), "Polly": ("PL", "PL"), "Laugh": ("LF", "LF"), "Chemistry": ("KMSTR", "KMSTR"), "Sugar": ("XKR", "SKR")}
    assert {w: metaphone(w) for w in known} == known

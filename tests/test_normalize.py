import pytest
from pyspark.sql import functions as F

from cairnlink.functions import normalize as N

#: Words that a dotted run may end with, or go on after, with and without a final dot or blanks between.
DOTTED = [
    ("Acme L.L.C", "acme llc"),
    ("Acme L.L.C.", "acme llc"),
    ("L. L. C", "llc"),
    ("L . L . C . of Kent", "llc of kent"),
    ("U.S.A Motors", "usa motors"),
    ("U.S.A. Motors", "usa motors"),
    ("Dupont S.A.R.L", "dupont sarl"),
    ("Dupont S.A.R.L.", "dupont sarl"),
    ("A.B.Company", "abcompany"),
    ("J.R. Tolk é.a.b", "jr tolk é ab"),
    ("St. Ives Co.", "st ives company"),
    ("x1.b.c", "x1 bc"),
]
#: Names, addresses and postal codes with the normal form that is required of them.
NAMES = [
    ("Custom Wealth Services LLC", "custom wealth services llc"),
    ("Summit Inc", "summit incorporated"),
    ("International South Consultants Private Ltd", "international south consultants private limited"),
    ("SHIVSHAKTI VIDYALAYA OVERSEAS CORPORATION | [www.shivshakti.com](https://www.shivshakti.com)", "shivshakti vidyalaya overseas corporation"),
    ("Société Générale SAS", "société générale sas"),
    ("LLC Moncada Learning Center", "llc moncada learning center"),
    ("Ectolumdrex dba X+ Madison Inc", "ectolumdrex doing business as x madison incorporated"),
    ('"6 Inch Sub Shop', "6 inch sub shop"),
    ("Acme P. Ltd.", "acme private limited"),
    ("Acme L.L.C.", "acme llc"),
    ("Foo societe anonyme", "foo sa"),
    ("null", ""),
    (None, ""),
]
ADDRESSES = [
    ("OH, Columbus, 5559 Orville Avenue", "oh columbus 5559 orville avenue"),
    ("GREENSBORO, NC, 19 1/2 STARDUST TRAIL", "greensboro nc 19 1/2 stardust trail"),
    ("##8 Willow Oak Lane, Fl. 0, Saint Louis, Missouri", "8 willow oak lane floor 0 saint louis missouri"),
    ("5780 Fawn Ct, 22Nd Main 9Th Block, Fort Worth, Texas", "5780 fawn court 22 main 9 block fort worth texas"),
    ("Block A, N Main", "block a n main"),
    ("5 N St", "5 north street"),
    ("Missing Link Road", ""),
    ("N/A", ""),
    (None, ""),
]
POSTAL = [
    ("KH NO. 570/13, NEW DELHI 110001", None, "110001"),
    ("1702 Pine Avenue, Menomonie, WI 54751", None, "54751"),
    ("914 Pierpont Ave, Cleveland, OH 44114-2201", None, "44114"),
    ("29 Boulevard Haussmann, 75009 Paris", None, "75009"),
    ("Lake Town Block A, Kolkata", None, None),
    ("H.No 570, Village Town 380001", None, "380001"),
    ("12045 Main St", "US", None),
    ("12045 Main St, Town 54751", "US", "54751"),
    ("54751", "US", "54751"),
]


@pytest.mark.parametrize(("make", "cases"), [(N.normalize_name, DOTTED), (N.normalize_name, NAMES), (N.normalize_address, ADDRESSES)])
def test_vectors(spark, make, cases):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, x string")
    found = {r.i: r.y for r in rows.select("i", make(F.col("x")).alias("y")).collect()}
    assert [found[i] for i in range(len(cases))] == [wanted for _, wanted in cases]


def test_landmark_keeps_the_rest(spark):
    row = spark.createDataFrame([("797, Lake Town Block A, Kolkata, near SBI Bank, Howrah",)], "x string")
    assert "lake town block a kolkata" in row.select(N.normalize_address(F.col("x"))).first()[0]


def test_postal(spark):
    rows = spark.createDataFrame([(i, a, c or "") for i, (a, c, _) in enumerate(POSTAL)], "i int, a string, c string")
    found = {r.i: r.p for r in rows.select("i", N.postal_code(F.col("a"), F.col("c")).alias("p")).collect()}
    assert [found[i] for i in range(len(POSTAL))] == [wanted for *_, wanted in POSTAL]


def test_country(spark):
    rows = spark.createDataFrame([("USA", "us"), ("United States of America", "us"), ("Bharat", "india"), ("France", "france"), ("Atlantis ", "atlantis")], "c string, wanted string")
    assert rows.where(N.canonical_country(F.col("c")) != F.col("wanted")).isEmpty()
    flags = spark.createDataFrame([("US", "USA", 1), ("India", "France", 0), ("US", "", None)], "a string, b string, wanted int")
    assert flags.where(~N.country_match(F.col("a"), F.col("b")).eqNullSafe(F.col("wanted"))).isEmpty()


def test_structural_fields_of_a_raw_address(spark):
    row = spark.createDataFrame([("1795 Westchester Drive, High Point, NC",)], "a string")
    assert tuple(row.select(N.street_number(F.col("a")), N.trailing_segment(F.col("a"))).first()) == ("1795", "NC")


def test_dots_as_the_rule_says(spark):
    """Every short string of letters, dots and blanks against the rule as one pattern."""
    import itertools
    import re

    rule = re.compile(r"\b(?:[a-zA-Z]\s*\.\s*)+[a-zA-Z]\b\.?")
    texts = ["".join(x) for n in range(1, 8) for x in itertools.product("a. b", repeat=n)][::7] + ["a.b.c.de f.g.", "q.r.s t", "a.b .c", "é.a.b", "a_.b.c"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    found = {r.i: r.y for r in rows.select("i", N.collapse_acronyms(F.col("x")).alias("y")).collect()}
    wrong = [(x, found[i]) for i, x in enumerate(texts) if found[i] != rule.sub(lambda m: re.sub(r"[.\s]+", "", m[0]), x)]
    assert wrong == []

"""Problem 1: trie, automaton and the two kinds of values."""

import random

import pytest

from millrace.llm import reference_match as rm
from millrace.llm.trie import Trie

PLACES = [(1, "Vancouver, British Columbia, Canada"), (2, "North Vancouver, British Columbia, Canada"), (3, "Richmond, British Columbia, Canada"), (4, "Richmond Hill, Ontario, Canada"), (5, "London, Ontario, Canada"), (6, "Montreal, Quebec, Canada"), (7, "Quebec City, Quebec, Canada"), (8, "Port Coquitlam, British Columbia, Canada"), (9, "Windsor, Ontario, Canada"), (57, "Remote, Canada"), (58, "Canada (any location)")]
SIZES = [(1, "1 to 10", 1, 10), (2, "11 to 50", 11, 50), (3, "51 to 200", 51, 200), (4, "201 to 500", 201, 500), (5, "501 to 1,000", 501, 1000), (6, "1,001 to 5,000", 1001, 5000), (7, "5,001 to 10,000", 5001, 10000), (8, "more than 10,000", 10001, None)]


def distance(a, b):
    """Edits with swaps of neighbours, by the table."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_the_table():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    trie = Trie((w, w) for w in words)
    for _ in range(200):
        q = "".join(rng.choice("abcde") for _ in range(rng.randint(0, 8)))
        for k in (0, 1, 2, 3):
            assert [(d, w) for d, w, _ in trie.search(q, k)] == sorted((distance(q, w), w) for w in words if distance(q, w) <= k)


@pytest.mark.parametrize(
    "value, ref",
    [
        ("VANCOUVER, BC", 1), ("Vancouver BC V8W1E1", 1), ("Hybrid - Vancouver, BC", 1), ("Vnacouver, BC, Canada", 1), ("Greater Vancouver Area", 1), ("Downtown Vancouver", 1), ("CA-BC-Vancouver", 1), ("British Columbia / Vancouver", 1),
        ("Canada, British Columbia, Vancouver", 1), ("North Vancovuer", 2), ("N. Vancouver, BC", 2), ("Vancouver North, BC", 2), ("Richmond", 3), ("Richmondhill", 4), ("RichmondH ill, ON", 4), ("Rich. Hill, ON", 4), ("London, Ontairo", 5),
        ("Montréal (Québec)", 6), ("Ville de Québec", 7), ("Québec, QC", 7), ("P. Coquitlam BC", 8), ("Remote", 57), ("WFH (Canada)", 57), ("Rmote, Canada", 57), ("Cananda", 58), ("Anywhere in Canada", 58), ("Canada-wide", 58),
        ("Vancouver, WA", -1), ("London, UK", -1), ("Windsor, CT", -1), ("Richmond, Ontario", -1), ("Remote (USA only)", -1), ("Melbourne", -1), ("n/a", -1), ("?", -1), ("x" * 5000, -1),
    ],
)
def test_places(value, ref):
    assert rm.LocationMatcher(PLACES).match(value[:400]) == ref


@pytest.mark.parametrize(
    "value, ref",
    [
        ("1–10 employees", 1), ("10 - 1", 1), ("1 to 1O", 1), ("under 10", 1), ("less than ten", 1), ("11 à 50 employés", 2), ("11_50", 2), ("11 too 50", 2), ("5l to 200", 3), ("51 t0 200", 3), ("201..500", 4), ("501..1 000", 5), ("0.5k-1k", 5),
        ("1K to 5K employees", 6), ("1,001 ot 5,000", 6), ("5 001_10 000", 7), ("10K+ employees", 8), ("over 10,000", 8), ("10,001 or more", 8), ("~408", 4), ("Team of 4", 1), ("about 18,000 staff", 8), ("4,143 employees worldwide", 6), ("startup", -1), ("Series B", -1), ("-", -1),
    ],
)
def test_sizes(value, ref):
    assert rm.SizeLabelMatcher(SIZES).match(value) == ref


def test_rows(spark):
    jobs = "job_id string, location string, company_employees_label string, ref_id int, value string"
    rows = [("a", "vancouver bc", "1 to 10", 1, "x"), ("b", None, "", 1, "x"), ("c", " ", "Team of 4", 1, "x"), ("d", "Remote, Canada", None, 1, "x"), ("a", "vancouver bc", "1 to 10", 1, "x")]
    places, sizes = spark.createDataFrame(PLACES, "ref_id long, location_name string"), spark.createDataFrame(SIZES, "ref_id long, size_label string, min_employees int, max_employees int")
    got = sorted((r.job_id, r.field_name, r.ref_id) for r in rm.canonical_values(spark.createDataFrame(rows, jobs), places, sizes).collect())
    assert got == [("a", "location", 1), ("a", "location", 1), ("c", "company_employees_label", 1)]
    assert rm.canonical_values(spark.createDataFrame([], jobs), places, sizes).count() == 0
    empty = rm.canonical_values(spark.createDataFrame(rows, jobs), places.limit(0), sizes.limit(0)).collect()
    assert {r.ref_id for r in empty} == {-1}


def test_the_whole_value_is_matched(spark):
    places = spark.createDataFrame(PLACES, "ref_id int, location_name string")
    sizes = spark.createDataFrame(SIZES, "ref_id int, size_label string, min_employees int, max_employees int")
    values = spark.createDataFrame([("late", "location", " " * 450 + "Vancouver, BC"), ("foreign", "location", "Vancouver" + " " * 450 + ", WA")], "k string, field_name string, value string")
    assert {r.k: r.ref_id for r in rm.map_values(values, ["k"], places, sizes).collect()} == {"late": 1, "foreign": -1}


def test_every_path_is_found_as_far_as_it_reaches():
    rng = random.Random(8)
    matcher = rm.LocationMatcher([(k, f"{city}, British Columbia, Canada") for k, city in enumerate(("North Vancouver", "Port Coquitlam", "Surrey", "Hope", "Terrace", "New Westminster"))])
    paths, stack = [], [matcher.cities.root]
    while stack:
        for letter, child in stack.pop().items():
            if letter:
                stack.append(child)
            else:
                paths += [(path, *payload) for path, payload in child]
    assert ("nvancouver", 0, 3, False) in paths and ("newwest", 5, 0, True) in paths
    for path, ref, far, abbreviation in paths:
        for _ in range(20):
            gone = set(rng.sample(range(len(path)), far))
            query = "".join(c for k, c in enumerate(path) if k not in gone)
            hits = {r for d, _, (r, most, _) in matcher.cities.search(query, rm.reach(len(query) + rm.MOST_EDITS)) if d <= most}
            assert ref in hits, (path, query)
            assert ref in {r for _, r in matcher._city(query)} or any(a for *_, a in [p[2:] for p in paths if p[0] == query]), (path, query)
    # an abbreviation is only met as it stands
    assert matcher._city("newwest") == ((0, 5),) and not any(r == 5 and d == 0 for d, r in matcher._city("newwset"))

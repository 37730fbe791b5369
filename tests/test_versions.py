from fleetops.operators.versions import backed_up_version, candidate_version, installed_version, resolve_versions, version_change
from tests.helpers import sorted_rows, table

TARGETS = "host_id BIGINT, package STRING, installed_version STRING, target_version STRING, force_upgrade STRING"
CANDIDATES = "package STRING, listing_rank BIGINT, version STRING"


def test_resolution(spark):
    targets = table(
        spark,
        TARGETS,
        (1, "p", "9.1-1", "9.1", "no"),
        (2, "p", "9.12-1", "latest", "no"),
        (3, "p", "9.12-1", "latest", "yes"),
        (4, "p", "8.2-1", "9.1-1", "no"),
        (5, "p", "9.12-1", "8", "no"),
        (6, "p", "9.1-1", "77", "no"),
        (7, "q", "9.1-1", "latest", "no"),
        (8, "p", "9.1-1", "9x1", "no"),
        (9, "p", "9.12-1", "9", None),
        (10, "p", None, "9", "no"),
    )
    candidates = table(
        spark, CANDIDATES, ("p", 2, "9.1-1"), ("p", 1, "9.12-1"), ("p", 3, "8.2-1"), ("p", 7, "9.12-1"), ("r", 0, "1")
    )
    resolved = resolve_versions(targets, candidates)
    assert sorted_rows(resolved, "host_id", "new_version", "status") == [
        (1, "9.12-1", "available"),
        (2, "9.12-1", "up_to_date"),
        (3, "9.12-1", "available"),
        (4, "9.1-1", "available"),
        (5, "8.2-1", "available"),
        (6, None, "not_found"),
        (7, None, "undetermined"),
        (8, None, "not_found"),
        (9, "9.12-1", "up_to_date"),
        (10, "9.12-1", "available"),
    ]
    assert sorted_rows(version_change(resolved))[:8] == [
        (1, "minor"),
        (2, "up_to_date"),
        (3, "minor"),
        (4, "major"),
        (5, "major"),
        (6, "not_found"),
        (7, "undetermined"),
        (8, "not_found"),
    ]


def test_offers_without_a_rank(spark):
    targets = table(spark, TARGETS, (1, "p", "1", "latest", "no"), (2, "p", "1", "9", "no"), (3, "q", "1", "latest", "no"))
    candidates = table(spark, CANDIDATES, ("p", None, "9.2"), ("p", None, "9.1"), ("q", None, "1.0"), ("q", 5, "2.0"))
    got = sorted_rows(resolve_versions(targets, candidates), "host_id", "new_version", "status")
    assert got == [(1, "9.1", "available"), (2, "9.1", "available"), (3, "2.0", "available")]


def test_installed_version(spark):
    listing = table(
        spark,
        "host_group STRING, line_no BIGINT, line STRING",
        ("a", 3, "ii  tool-web  3.0  all"),
        ("a", 2, "rc  tool-web-extra  2.0  all"),
        ("b", 1, "ii other 1.0"),
        ("c", 1, "ii tool-web"),
    )
    assert sorted_rows(installed_version(listing, "tool-web")) == [("a", "2.0"), ("b", None), ("c", None)]
    assert sorted_rows(installed_version(listing, "tool-web", True)) == [("a", "3.0"), ("b", None), ("c", None)]


def test_backed_up_version(spark):
    lines = table(
        spark,
        "backup_id BIGINT, line_no BIGINT, line STRING",
        (1, 1, "=== Upgrade Information ==="),
        (1, 2, "Old Version: 9.1-1"),
        (2, 1, "  Old Version: 8"),
    )
    assert sorted_rows(backed_up_version(lines)) == [(1, "9.1-1"), (2, None)]


def test_candidate_version(spark):
    lines = table(
        spark,
        "host_id BIGINT, line_no BIGINT, line STRING",
        (1, 1, "tool-web:"),
        (1, 2, "  Installed: 9.0-1"),
        (1, 3, "  Candidate: 9.1-1"),
        (2, 1, "tool-web:"),
    )
    assert sorted_rows(candidate_version(lines)) == [(1, "9.1-1"), (2, None)]


def test_blank_targets_find_nothing(spark):
    targets = table(spark, TARGETS, (1, "p", "9.1-1", "", "no"), (2, "p", "9.1-1", None, "yes"), (3, "p", "9.1-1", "9", "no"))
    candidates = table(spark, CANDIDATES, ("p", 1, "9.2-1"), ("p", 1, "9.10-1"), (None, 1, "9.1-1"))
    got = sorted_rows(resolve_versions(targets, candidates), "host_id", "new_version", "status")
    assert got == [(1, None, "not_found"), (2, None, "not_found"), (3, "9.10-1", "available")]

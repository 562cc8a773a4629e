import pytest

from vistaframe.llm.queries import op1_url_filters
from vistaframe.llm.url_filter import listed_hosts

HOSTS = {
    "m.casino-win.example.com": "casino-win.example.com/",
    "blog.adult-x.example.net": "adult-x.example.net/",
    "WWW.Best-Poker24.io": "best-poker24.io/",
    "poker.play.bets.co.uk": "bets.co.uk/",
    "x.casino": "casino/",
    "bet365.com": "bet365.com/",
    "ads.": "ads./",
    "essex.ac.uk": None,
    "alphabet.com": None,
    "downloads.example.com": None,
    "spamalot.org": None,
    "": None,
}


def test_hosts_are_listed_by_category(spark):
    pages = spark.createDataFrame([(f"http://{h}/a",) for h in [*HOSTS, *HOSTS]] + [(None,), ("casino",)], "url string")
    got = [tuple(r) for r in listed_hosts(pages).collect()]
    assert sorted(got) == sorted((p, "block", False) for p in HOSTS.values() if p)


@pytest.mark.parametrize("host", ["m.casino-win.example.com", "blog.adult-x.example.net", "x.free-slots.net", "spam-farm.example.org"])
def test_query_blocks_listed_hosts_unless_a_rule_fits(spark, tmp_path, host):
    rows = [(1, f"http://{host}/a"), (2, f"http://{host}/fr/a"), (3, "http://plain.example.com/casino")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in op1_url_filters(spark, str(tmp_path)).collect()}
    assert got == {1: "allow" if host.endswith("org") else "block", 2: "block" if host.endswith("net") else "allow", 3: "allow"}

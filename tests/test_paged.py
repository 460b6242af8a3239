"""Pages of a service: all rows once, failures tried again, streams go on where they stopped."""

import os

import pytest

from auditlake.sources import paged
from auditlake.streaming.state import run_available


def service(folder, pages, fails=()):
    """fetch(page) over files; a page of `fails` fails twice, wherever it is asked for."""

    def fetch(page):
        if page in fails:
            n = len([x for x in os.listdir(folder) if x.startswith(f"try-{page}-")])
            if n < 2:
                open(f"{folder}/try-{page}-{n}", "w").close()
                raise OSError("503")
        there = int(open(f"{folder}/pages").read())
        return [(page, k, None if k == 1 else f"é{k}") for k in range(3)] if page < there else None

    (folder / "pages").write_text(str(pages))
    return fetch


def test_batch_reads_every_page_and_tries_again(spark, tmp_path):
    got = paged.read_pages(spark, "svc_a", "page long, k int, text string", service(tmp_path, 7, {3}), 7, tasks=3, pause=0.01)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(p, k, None if k == 1 else f"é{k}") for p in range(7) for k in range(3)], key=repr)
    assert len([x for x in os.listdir(tmp_path) if x.startswith("try-3")]) == 2
    assert paged.read_pages(spark, "svc_b", "page long, k int, text string", service(tmp_path, 0), 0).count() == 0


def test_after_the_last_try_the_error_is_told(spark, tmp_path):
    with pytest.raises(Exception, match="503"):
        paged.read_pages(spark, "svc_c", "page long, k int, text string", service(tmp_path, 2, {1}), 2, tries=1, pause=0.01).count()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    fetch = service(tmp_path, 2, {1})

    def run(n):
        out = f"{tmp_path}/out{n}"
        s = paged.stream_pages(spark, "svc_d", "page long, k int, text string", fetch, pause=0.01, most=2)
        run_available(s, lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch={k}"), f"{tmp_path}/checkpoint").awaitTermination(90)
        return sorted({r.page for r in spark.read.parquet(out).collect()}), spark.read.parquet(out).count()

    assert run(1) == ([0, 1], 6)
    (tmp_path / "pages").write_text("5")
    assert run(2)[0][0] == 2


def test_a_run_over_what_is_available_reads_every_page(spark, tmp_path):
    asks = tmp_path / "asks"
    asks.mkdir()
    fetch = service(tmp_path, 260)

    def noted(page):
        (asks / f"{page}-{os.getpid()}-{len(os.listdir(asks))}").touch()
        return fetch(page)

    s = paged.stream_pages(spark, "svc_e", "page long, k int, text string", noted, pause=0.01, tasks=4)
    run_available(s, lambda b, k: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}"), f"{tmp_path}/checkpoint").awaitTermination(90)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.page, r.k) for r in got.select("page", "k").collect()) == [(p, k) for p in range(260) for k in range(3)]
    assert len(os.listdir(asks)) < 260 + 80  # each page once by the tasks; the driver asks for few


def test_service_streams_all_rows_of_keys_with_gaps(spark, tmp_path):
    from auditlake.plans import kept

    keys = [*range(1, 60), 10_000, 10_001, *range(2_000_000, 2_006_000)]
    spark.createDataFrame([(k, f"n{k}", k % 50) for k in keys], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    for q in (kept.service_stream, kept.service_pages):
        assert sorted(r.p_partkey for r in q(spark, str(tmp_path)).collect()) == keys


@pytest.mark.parametrize("there", [0, 1, 2, 3, 7, 8, 9])
@pytest.mark.parametrize("most", [None, 1, 4, 20])
def test_end_of_what_is_there(there, most):
    reader = paged._Stream(lambda page: [(page,)] if page < there else None, 0, most, 8, 1, 0.0)
    seen = [reader.latestOffset()["page"] for _ in range(11)]
    assert seen[-1] == there and all(b - a <= (most or there) for a, b in zip([0, *seen], seen))
    parts = reader.partitions({"page": 0}, {"page": there})
    assert [k for p in parts for k in range(p.first, p.last)] == list(range(there))

import pytest

from pairlens.streaming import requests

SCHEMA = requests.REQUESTS


def rows(*keys):
    return [(f"k{k}", "s", f"ask {k}") for k in keys]


def test_each_request_is_asked_once_over_restarts(spark, tmp_path):
    path, out, state, calls = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", tmp_path / "calls"
    calls.mkdir()

    def judge(prompt):
        import uuid

        (calls / f"{prompt.split()[1]}-{uuid.uuid4().hex}").touch()
        if prompt == "ask 7" and not (tmp_path / "well").exists():
            raise SystemExit("the task is gone")
        return f"said {prompt}"

    def asked(k):
        return len(list(calls.glob(f"{k}-*")))

    def run():
        return requests.run_available(requests.answered(requests.read_requests(spark, path, 1), judge, retries=0), out, state)

    def put(*keys):
        spark.createDataFrame(rows(*keys), SCHEMA).coalesce(1).write.mode("append").parquet(path)

    put(1, 2, 2, 3)
    assert run() == 1
    put(2, 3, 4)
    put(1, 4, 5)
    assert run() == 2
    put(5, 6, 7)
    with pytest.raises(Exception):  # noqa: B017
        run()
    (tmp_path / "well").touch()
    put(7, 8, 1)
    assert run() >= 1 and run() == 0
    got = sorted((r.request_key, r.response) for r in spark.read.parquet(out).collect())
    assert got == [(f"k{k}", f"said ask {k}") for k in range(1, 9)]
    assert all(asked(k) == 1 for k in (1, 2, 3, 4, 5, 8)) and asked(7) >= 2

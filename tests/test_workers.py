"""What Python workers are started with."""

import pyarrow as pa


def test_workers_give_memory_back(spark):
    def run(batches):
        import os

        held = lambda: int(next(l for l in open("/proc/self/smaps_rollup") if l.startswith("Anonymous:")).split()[1]) / 1024
        for b in batches:
            before = held()
            data = [bytearray(400_000) for _ in range(250)]
            keep, data = data[-1], None
            after = held()
            yield pa.RecordBatch.from_pydict({"pool": [pa.default_memory_pool().backend_name], "arenas": [os.environ.get("MALLOC_ARENA_MAX")], "grown": [after - before], "n": [len(keep)]})

    r = spark.range(0, 1, 1, 1).mapInArrow(run, "pool string, arenas string, grown double, n long").first()
    assert r.pool == "system" and r.arenas == "2" and r.grown < 20

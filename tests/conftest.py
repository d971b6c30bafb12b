import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kinefold.session import build_session

    s = build_session(master="local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s


PERSON = "struct<id bigint, role string, team string, jersey string, box array<double>, xy array<double>>"
FRAMES = (f"match_id string, frame bigint, delay int, people array<{PERSON}>, ball struct<box array<double>, xy array<double>>, colors struct<left string, right string>, "
          "line_no bigint, ingested_at timestamp")


@pytest.fixture(scope="session")
def make_frames(spark):
    """make_frames({(match, frame): [(id, x, y[, role, team, jersey]), ...]}, ball={...}): a frames table in arrival order."""
    def make(lines, ball=None):
        rows = []
        for n, ((match, frame), people) in enumerate(lines.items() if isinstance(lines, dict) else lines, 1):
            entries = None if people is None else [
                (p[0], p[3] if len(p) > 3 else "player", p[4] if len(p) > 4 else "left", p[5] if len(p) > 5 else "7", [0.0, 0.0, 10.0, 20.0],
                 None if p[1] is None else [float(p[1]), float(p[2])]) for p in people]
            b = (ball or {}).get((match, frame))
            rows.append((match, frame, 25, entries, None if b is None else ([0.0] * 4, [float(v) for v in b]), None, n, None))
        return spark.createDataFrame(rows, FRAMES)
    return make

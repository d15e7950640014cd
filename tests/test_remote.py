import http.server
import threading
import urllib.error

import pytest
from pyspark.sql import functions as F
from stationweave.sources import remote

PAGES = {"/a.csv": "DATE,TMP\n2024-01-01T00:00:00,\"+0022,1\"\n", "/b.csv": "DATE,TMP\n2024-01-02T00:00:00,\"-0011,1\"\n"}


@pytest.fixture(scope="module")
def server():
    failed = set()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/flaky" and self.path not in failed:
                failed.add(self.path)
                return self.send_error(503)
            body = PAGES.get(self.path, "ok" if self.path == "/flaky" else None)
            if body is None:
                return self.send_error(404)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_lines_of_several_urls(spark, server):
    df = remote.http_lines(spark, [server + p for p in PAGES], rate=1000, header=1)
    rows = df.select(F.from_csv("value", "d string, t string").alias("r")).select("r.*").orderBy("d").collect()
    assert [tuple(r) for r in rows] == [("2024-01-01T00:00:00", "+0022,1"), ("2024-01-02T00:00:00", "-0011,1")]


def test_download(server, tmp_path):
    path = str(tmp_path / "x")
    assert remote.download(server + "/flaky", path, wait_s=0.01) == 2 and (tmp_path / "x").read_text() == "ok"
    with pytest.raises(urllib.error.HTTPError):
        remote.download(server + "/none", str(tmp_path / "y"), wait_s=0.01)
    assert [p.name for p in tmp_path.iterdir()] == ["x"]


def test_pace():
    now, slept = [0.0], []
    p = remote.Pace(2.0, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        p.wait()
    assert slept == [0.5, 0.5]

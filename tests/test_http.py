import json
import threading
import urllib.error
import urllib.request

from docspark.http_api import server
from docspark.kb import Store


def test_api(spark, tmp_path):
    web = server(Store(spark, f"file://{tmp_path}/kb"), 0, key="k")
    threading.Thread(target=web.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{web.server_address[1]}"

    def call(path, body=None, key="k"):
        request = urllib.request.Request(at + path, None if body is None else body.encode(), {"X-API-Key": key})
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/health")[0] == 200 and call("/ready")[0] == 503 and call("/nowhere")[0] == 404
        assert call("/status")[1]["ready"] is False
        assert call("/api/query", "{}")[0] == 400 and call("/api/query", "[")[0] == 400
        assert call("/api/query", '{"query": "x"}', "wrong")[0] == 401
        assert call("/api/query", json.dumps({"query": "x" * 2001}))[0] == 413
        assert call("/api/query", '{"query": "nothing is published"}')[0] == 502
    finally:
        web.shutdown()

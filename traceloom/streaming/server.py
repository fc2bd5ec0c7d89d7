"""HTTP and WebSockets over the live engine, with the standard library: health, stats, query, watch, alerts, pair state
and ingest.

Bodies are JSON; an error is {"error": text}. Events that are sent go to the engine's source folder as a file, which the
stream takes like any other: a file a request, and a file every sampling interval for what came through /ws/ingest.
/ws/alerts gets every alert as it is delivered, and takes watch, unwatch and ping.
"""

from __future__ import annotations

import json
import socket
import struct
import sys
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from traceloom.operators.anomaly import recent_alerts
from traceloom.streaming.realtime import Engine
from traceloom.streaming.storage import Files
from traceloom.streaming.websocket import FAILED, VERSION, Socket, accept_key


class BadRequest(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def events_of(body: str) -> list[dict]:
    """The events of a payload, one event or an array of events; anything else is ignored. ValueError if it is no JSON."""
    got = json.loads(body)
    return [e for e in (got if isinstance(got, list) else [got]) if isinstance(e, dict)]


def put_events(files: Files, events: list[dict]) -> None:
    files.put(f"{time.time_ns()}-{uuid.uuid4().hex}.json", "\n".join(map(json.dumps, events)))


def drop(files: Files, body: str) -> int:
    """Put a payload into a source folder; what is no event is ignored. The number sent."""
    try:
        events = events_of(body)
    except ValueError:
        return 0
    if events:
        put_events(files, events)
    return len(events)


class Spool:
    """Events in order of arrival, put into a source folder as one file every `every` seconds, or as soon as there are
    `most`. Senders wait while a file is written; events whose file could not be written stay for the next."""

    def __init__(self, files: Files, every: float, most: int = 10_000):
        self.files, self.every, self.most = files, every, most
        self.events: list[dict] = []
        self.lock, self.ended = threading.Lock(), threading.Event()
        threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        while not self.ended.wait(self.every):
            try:
                self.flush()
            except Exception as e:  # noqa: BLE001
                print(f"events wait, as their file could not be written: {e}", file=sys.stderr)

    def add(self, events: list[dict]) -> None:
        with self.lock:
            self.events += events
            full = len(self.events) >= self.most
        if full:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            if self.events:
                put_events(self.files, self.events)
                self.events = []

    def close(self) -> None:
        self.ended.set()
        self.flush()


class Api:
    """What each route does; the handler only speaks HTTP."""

    def __init__(self, engine: Engine, source: str):
        self.engine, self.source, self.lock = engine, Files(engine.spark, source), threading.Lock()
        self.clients: dict[str, set[Socket]] = {"/ws/ingest": set(), "/ws/alerts": set()}

    def set_watch(self, cause: str, effect: str, on: bool) -> None:
        with self.lock:
            (self.engine.watch if on else self.engine.unwatch)(cause, effect)

    def broadcast(self, alert: dict) -> None:
        """Send an alert to all who listen; who cannot take it is dropped."""
        text = json.dumps({"type": "alert", "data": alert}, ensure_ascii=False)
        for client in list(self.clients["/ws/alerts"]):
            try:
                client.send(text)
            except OSError:
                client.close(FAILED)

    def ingest(self, client: Socket, body: str, spool: Spool) -> None:
        try:
            spool.add(events_of(body))
        except ValueError:
            client.send(json.dumps({"type": "error", "message": "Invalid JSON payload"}))

    def order(self, client: Socket, body: str) -> None:
        """watch, unwatch or ping; anything else is ignored."""
        try:
            x = json.loads(body)
        except ValueError:
            return
        action = x.get("action") if isinstance(x, dict) else None
        if action == "ping":
            client.send(json.dumps({"type": "pong", "server_time": time.time()}))
        if action in ("watch", "unwatch"):
            try:
                cause, effect = self.pair(body)
            except BadRequest:
                return
            self.set_watch(cause, effect, action == "watch")
            client.send(json.dumps({"type": f"{action}_ack", "cause": cause, "effect": effect, "watched": action == "watch"}))

    def converse(self, path: str, client: Socket, spool: Spool) -> None:
        """Serve one open connection until it ends."""
        self.clients[path].add(client)
        try:
            client.send(json.dumps({"type": "welcome", "message": f"connected to {path}", "server_time": time.time()}))
            while (body := client.receive()) is not None:
                self.ingest(client, body, spool) if path == "/ws/ingest" else self.order(client, body)
        except OSError:
            pass
        except Exception:
            client.close(FAILED)
            raise
        finally:
            self.clients[path].discard(client)

    def pair(self, body: str) -> tuple[str, str]:
        try:
            x = json.loads(body)
            cause, effect = x["cause"], x["effect"]
        except (ValueError, KeyError, TypeError):
            raise BadRequest(422, "cause and effect are needed") from None
        if not (isinstance(cause, str) and isinstance(effect, str)):
            raise BadRequest(422, "cause and effect are texts")
        return cause, effect

    def call(self, method: str, url: str, body: str = "") -> dict:
        at = urlparse(url)
        args = {k: v[-1] for k, v in parse_qs(at.query).items()}
        name = f"{method} {at.path.rstrip('/')}"
        engine = self.engine
        if name == "GET /api/health":
            return engine.health() | {f"{path[4:].rstrip('s')}_clients": len(found) for path, found in self.clients.items()}
        if name == "GET /api/stats":
            return engine.stats()
        if name == "POST /api/query":
            return engine.query(*self.pair(body))
        if name in ("POST /api/watch", "DELETE /api/watch"):
            cause, effect = self.pair(body)
            self.set_watch(cause, effect, method == "POST")
            return {"status": "ok", "cause": cause, "effect": effect, "watched": method == "POST"}
        if name == "GET /api/watch":
            pairs = engine.watched()
            return {"count": len(pairs), "pairs": [{"cause": c, "effect": e} for c, e in pairs]}
        if name == "GET /api/alerts":
            try:
                found = recent_alerts(engine.alerts(), int(args.get("limit", 50)), float(args.get("since", 0)))
            except ValueError as e:
                raise BadRequest(422, str(e)) from None
            rows = [r.asDict(True) for r in found.collect()]
            return {"count": len(rows), "alerts": rows}
        if name == "GET /api/pair_state":
            if not ("cause" in args and "effect" in args):
                raise BadRequest(422, "cause and effect are needed")
            state = engine.pair_state(args["cause"], args["effect"])
            if state is None:
                raise BadRequest(404, "Pair not found")
            return state
        if name == "POST /api/ingest":
            return {"status": "ok", "events": drop(self.source, body)}
        raise BadRequest(404, "Not found")


def serve(engine: Engine, source: str, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    """A server that runs in threads of its own; shutdown() ends it. Port 0 takes a free one. Alerts that the engine
    delivers go to its own callback first and to the sockets then."""
    api, own = Api(engine, source), engine.on_alert
    spool = Spool(api.source, engine.sample_s)

    def alerted(alert: dict) -> None:
        if own:
            own(alert)
        api.broadcast(alert)

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            if self.command == "GET" and self.headers.get("Upgrade", "").lower() == "websocket":
                return self.upgrade()
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            try:
                status, value = 200, api.call(self.command, self.path, body)
            except BadRequest as e:
                status, value = e.status, {"error": str(e)}
            except Exception as e:  # noqa: BLE001
                status, value = 500, {"error": str(e)}
            self.reply(status, value)

        do_GET = do_POST = do_DELETE = answer

        def reply(self, status: int, value: dict, **headers: str):
            data = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            for name, text in {"Content-Type": "application/json; charset=utf-8", "Content-Length": str(len(data)), **headers}.items():
                self.send_header(name, text)
            self.end_headers()
            self.wfile.write(data)

        def upgrade(self):
            path, key = urlparse(self.path).path.rstrip("/"), self.headers.get("Sec-WebSocket-Key")
            if path not in api.clients:
                return self.reply(404, {"error": "Not found"})
            if not key or self.headers.get("Sec-WebSocket-Version") != VERSION:
                return self.reply(426, {"error": "a WebSocket of another version"}, **{"Sec-WebSocket-Version": VERSION})
            agreed = ["HTTP/1.1 101 Switching Protocols", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Accept: {accept_key(key)}"]
            self.wfile.write("\r\n".join([*agreed, "", ""]).encode())
            # A client that takes nothing for ten seconds must not hold up the alerts of the others.
            self.connection.setsockopt(socket.SOL_SOCKET, socket.SO_SNDTIMEO, struct.pack("ll", 10, 0))
            self.close_connection = True
            api.converse(path, Socket(self.rfile, self.wfile.write, client=False), spool)

        def log_message(self, *_):
            pass

    class Server(ThreadingHTTPServer):
        def shutdown(self):
            super().shutdown()
            self.server_close()
            for client in [c for found in api.clients.values() for c in found]:
                client.close()
            engine.on_alert = own
            spool.close()

    server = Server((host, port), Handler)
    engine.on_alert = alerted
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server

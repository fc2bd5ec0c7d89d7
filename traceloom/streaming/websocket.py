"""WebSockets (RFC 6455) over a connected stream: text messages in both directions, pings, closing; for both ends."""

from __future__ import annotations

import base64
import hashlib
import os
import socket
import struct
import threading
from urllib.parse import urlparse

#: Fixed values of the protocol.
GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
VERSION = "13"
CONTINUED, TEXT, BINARY, CLOSE, PING, PONG = 0, 1, 2, 8, 9, 10
WRONG, NOT_TEXT, NOT_UTF8, TOO_LARGE, FAILED = 1002, 1003, 1007, 1009, 1011
#: Bytes of a message; a larger one ends the connection.
LARGEST = 1 << 26


def accept_key(key: str) -> str:
    return base64.b64encode(hashlib.sha1((key + GUID).encode()).digest()).decode()


def xor(data: bytes, key: bytes) -> bytes:
    n = len(data)
    over = (key * (n // 4 + 1))[:n]
    return (int.from_bytes(data, "big") ^ int.from_bytes(over, "big")).to_bytes(n, "big")


class Ended(Exception):
    """The connection is to be closed with this code."""

    def __init__(self, code: int):
        super().__init__(code)
        self.code = code


class Socket:
    """One end of an open connection. client: this end masks what it sends, the other does not."""

    def __init__(self, reader, write, client: bool, shut=None):
        self.reader, self.write, self.client, self.shut = reader, write, client, shut
        self.lock, self.open = threading.Lock(), True

    def _put(self, kind: int, data: bytes) -> None:
        n, mask = len(data), 0x80 if self.client else 0
        head = bytes([0x80 | kind])
        if n < 126:
            head += bytes([mask | n])
        elif n < 1 << 16:
            head += struct.pack("!BH", mask | 126, n)
        else:
            head += struct.pack("!BQ", mask | 127, n)
        if self.client:
            key = os.urandom(4)
            head, data = head + key, xor(data, key)
        with self.lock:
            self.write(head + data)

    def _read(self, n: int) -> bytes:
        data = self.reader.read(n)
        if len(data) < n:
            raise EOFError
        return data

    def _frame(self, room: int) -> tuple[bool, int, bytes]:
        """Whether it is a message's last frame, its kind and its bytes."""
        first, second = self._read(2)
        last, kind, n = bool(first & 0x80), first & 0x0F, second & 0x7F
        if first & 0x70 or kind not in (CONTINUED, TEXT, BINARY, CLOSE, PING, PONG) or bool(second & 0x80) == self.client:
            raise Ended(WRONG)
        if kind >= CLOSE and (n > 125 or not last):
            raise Ended(WRONG)
        if n == 126:
            (n,) = struct.unpack("!H", self._read(2))
        elif n == 127:
            (n,) = struct.unpack("!Q", self._read(8))
        if kind < CLOSE and n > room:
            raise Ended(TOO_LARGE)
        key = b"" if self.client else self._read(4)
        data = self._read(n)
        return last, kind, xor(data, key) if key else data

    def send(self, text: str) -> None:
        self._put(TEXT, text.encode())

    def receive(self) -> str | None:
        """The next message; None when the other end has left or broke the protocol."""
        parts: list[bytes] = []
        begun = False
        try:
            while True:
                last, kind, data = self._frame(LARGEST - sum(map(len, parts)))
                if kind == CLOSE:
                    self.close(struct.unpack("!H", data[:2])[0] if len(data) > 1 else 1000)
                    return None
                if kind == PING:
                    self._put(PONG, data)
                elif kind == BINARY:
                    raise Ended(NOT_TEXT)
                elif kind != PONG:
                    if (kind == CONTINUED) != begun:
                        raise Ended(WRONG)
                    parts.append(data)
                    begun = True
                    if last:
                        return b"".join(parts).decode()
        except UnicodeDecodeError:
            self.close(NOT_UTF8)
        except Ended as e:
            self.close(e.code)
        except (EOFError, OSError):
            self.open = False
        return None

    def close(self, code: int = 1000) -> None:
        if self.open:
            self.open = False
            try:
                self._put(CLOSE, struct.pack("!H", code))
            except OSError:
                pass
        if self.shut:
            self.shut()

    def finish(self) -> None:
        """Close once the other end has taken all that was sent. Closing with its messages unread could lose some of it."""
        self.open = False
        try:
            self._put(CLOSE, struct.pack("!H", 1000))
        except OSError:
            pass
        while self.receive() is not None:
            pass
        if self.shut:
            self.shut()


def connect(url: str, timeout: float | None = 60) -> Socket:
    """The client's end of ws://host:port/path. ConnectionError if the server does not agree."""
    at = urlparse(url)
    sock = socket.create_connection((at.hostname, at.port or 80), timeout)
    key = base64.b64encode(os.urandom(16)).decode()
    asked = [f"GET {at.path or '/'} HTTP/1.1", f"Host: {at.netloc}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key}", f"Sec-WebSocket-Version: {VERSION}"]
    sock.sendall("\r\n".join([*asked, "", ""]).encode())
    reader = sock.makefile("rb")
    status, agreed = reader.readline().decode("latin-1"), {}
    while (line := reader.readline().decode("latin-1").strip()):
        name, _, value = line.partition(":")
        agreed[name.lower()] = value.strip()
    if status.split()[1:2] != ["101"] or agreed.get("sec-websocket-accept") != accept_key(key):
        sock.close()
        raise ConnectionError(f"{url}: {status.strip() or 'no answer'}")
    return Socket(reader, sock.sendall, client=True, shut=sock.close)

"""Opt-in download of a remote manifest, on the driver or in a hook: HTTPS to public addresses only, bounded, without redirects."""

from __future__ import annotations

import http.client
import ipaddress
import json
import socket
import ssl
from urllib.parse import urlsplit

MOST, SECONDS = 2 << 20, 5.0


def public_address(host: str, resolve=socket.getaddrinfo) -> str:
    """An address of the host, if all of them are public; ValueError otherwise."""
    found = sorted({x[4][0] for x in resolve(host, 443, type=socket.SOCK_STREAM)})
    if not found or not all(ipaddress.ip_address(x).is_global for x in found):
        raise ValueError("the manifest's host has no public address")
    return found[0]


def checked_url(url: str):
    u = urlsplit(url)
    if u.scheme != "https" or not u.hostname or u.username or u.password or u.fragment or u.port not in (None, 443):
        raise ValueError("a manifest is loaded by plain HTTPS on port 443 only")
    return u


class _Pinned(http.client.HTTPSConnection):
    """Connects to the address that was checked, whatever the name resolves to later."""

    def __init__(self, host: str, address: str):
        super().__init__(host, 443, timeout=SECONDS, context=ssl.create_default_context())
        self._address = address

    def connect(self):
        plain = socket.create_connection((self._address, 443), SECONDS)
        self.sock = self._context.wrap_socket(plain, server_hostname=self.host)


def load_manifest(url: str):
    u = checked_url(url)
    link = _Pinned(u.hostname, public_address(u.hostname))
    try:
        link.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""))
        answer = link.getresponse()
        if answer.status != 200:
            raise ValueError(f"the manifest's host answered {answer.status}")
        data = answer.read(MOST + 1)
    finally:
        link.close()
    if len(data) > MOST:
        raise ValueError("the remote manifest is too long")
    try:
        return json.loads(data)
    except ValueError:
        return data

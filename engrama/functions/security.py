"""Text encryption and hybrid logical clocks as column functions and small driver-side helpers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypt(text: Column, key: Column) -> Column:
    """AES-GCM with a random nonce, base64; null stays null."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT")))


def decrypt(text: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(text), key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def wrap_key(data_key: Column, master: Column) -> Column:
    """A data key under the master key, for envelope encryption."""
    return F.base64(F.aes_encrypt(data_key, master, F.lit("GCM"), F.lit("DEFAULT")))


def unwrap_key(wrapped: Column, master: Column) -> Column:
    return F.aes_decrypt(F.unbase64(wrapped), master, F.lit("GCM"), F.lit("DEFAULT"))


class Clock(NamedTuple):
    """A hybrid logical clock reading; tuples order as their causes do."""

    ms: int
    counter: int
    node: int

    def tick(self, now_ms: int) -> Clock:
        return Clock(now_ms, 0, self.node) if now_ms > self.ms else Clock(self.ms, self.counter + 1, self.node)

    def receive(self, other: Clock, now_ms: int) -> Clock:
        top = max(self.ms, other.ms, now_ms)
        if top == self.ms == other.ms:
            return Clock(top, max(self.counter, other.counter) + 1, self.node)
        if top == self.ms:
            return Clock(top, self.counter + 1, self.node)
        if top == other.ms:
            return Clock(top, other.counter + 1, self.node)
        return Clock(top, 0, self.node)

    def to_bytes(self) -> bytes:
        """16 bytes, big-endian, so that they compare as clocks do."""
        return self.ms.to_bytes(8, "big") + self.counter.to_bytes(4, "big") + self.node.to_bytes(4, "big")


def clock_column(ms: Column, counter: Column, node: Column) -> Column:
    return F.struct(ms.cast("long").alias("ms"), counter.cast("int").alias("counter"), node.cast("long").alias("node"))

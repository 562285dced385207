"""Parameters of the supported chains, and what is derived from them."""

from __future__ import annotations

import copy
import hashlib
import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Chain and network codes of file headers; address versions; undo windows and depths by chain.
CHAINS = {"BTC": "bitcoin", "LTC": "litecoin", "DOGE": "dogecoin"}
CHAIN_CODES = {"bitcoin": 1, "litecoin": 2, "dogecoin": 3}
NET_CODES = {"mainnet": 1, "testnet": 2, "regtest": 3}
UNDO_BLOCKS = {"BTC": 12, "LTC": 48, "DOGE": 120}
UNDO_DEFAULT, UNDO_WARN = 12, 126
ADDRESSES = {
    "bitcoin-mainnet": (0, 5, "bc"), "bitcoin-testnet": (111, 196, "tb"), "bitcoin-regtest": (111, 196, "bcrt"),
    "litecoin-mainnet": (48, 50, "ltc"), "litecoin-testnet": (111, 58, "tltc"), "litecoin-regtest": (111, 58, "rltc"),
    "dogecoin-mainnet": (30, 22, None), "dogecoin-testnet": (113, 196, None), "dogecoin-regtest": (111, 196, None),
}


@dataclass
class CoinConfig:
    tick: str
    network: str
    undo_blocks: int
    confirmations: int = 6
    maturity: int = 100
    versions: list = field(default_factory=list)


def networks() -> list[str]:
    return list(ADDRESSES)


def network_params(name: str) -> dict:
    """Address versions of `<coin>-<net>`; raises for an unknown one."""
    if name not in ADDRESSES:
        raise KeyError(f"unknown network {name!r}")
    pubkey, script, hrp = ADDRESSES[name]
    return {"pubkey_hash": pubkey, "script_hash": script, "bech32": hrp}


def codes(network: str) -> tuple[int, int]:
    chain, _, net = network.partition("-")
    return CHAIN_CODES[chain], NET_CODES[net]


def coin_of(network: str | None) -> str | None:
    return next((t for t, n in CHAINS.items() if network and network.lower().startswith(n)), None)


def coin_of_column(network: Column) -> Column:
    low = F.lower(network)
    return F.when(low.startswith("bitcoin"), "BTC").when(low.startswith("litecoin"), "LTC").when(low.startswith("dogecoin"), "DOGE")


def env_int(raw: str | None, fallback: int, least: int) -> int:
    """A whole number of at least `least`, else the fallback."""
    try:
        n = int(raw) if raw is not None else fallback
    except ValueError:
        return fallback
    return n if n >= least else fallback


def env_switch(raw: str | None) -> bool:
    return (raw or "").strip().lower() in ("1", "true", "yes", "on")


def coerce(raw: str, kind: str):
    """A typed value of text: int, csv, csv_lower, csv_sparse (empty places stay, as None) or str."""
    parts = [p.strip() for p in raw.split(",")]
    if kind == "int":
        return int(raw)
    if kind == "csv":
        return [p for p in parts if p]
    if kind == "csv_lower":
        return [p.lower() for p in parts if p]
    if kind == "csv_sparse":
        return [p or None for p in parts]
    return raw


def row_limit(raw: str | None, default: int) -> int:
    """A limit where 0 or less switches it off."""
    return max(0, env_int(raw, default, -(1 << 62)))


def undo_blocks(network: str, option: int | None = None, env: str | None = None) -> int:
    """Option before environment before the chain's default."""
    default = UNDO_BLOCKS.get(coin_of(network) or "", UNDO_DEFAULT)
    n = option if option is not None else env_int(env if env is not None else os.environ.get("UNDO_BLOCKS"), default, 1)
    if n < 1:
        raise ValueError("an undo window has at least one block")
    return n


def confirmations_for(config: CoinConfig, override: int | None = None) -> int:
    """An override may lower the depth on test networks only."""
    n = override if override is not None else config.confirmations
    return max(n, config.confirmations) if config.network == "mainnet" else n


def coin_config(tick: str, network: str, overrides: dict | None = None) -> CoinConfig:
    """Parameters with overrides, which count on regtest only."""
    out = CoinConfig(tick, network, UNDO_BLOCKS[tick], versions=list(ADDRESSES[f"{CHAINS[tick]}-{network}"][:2]))
    if network == "regtest":
        for k, v in (overrides or {}).items():
            setattr(out, k, v)
    return out


def config_table(spark: SparkSession) -> DataFrame:
    """One row a chain and network: a fixed, small dimension."""
    rows = [(coin_of(n), n.partition("-")[2], n, *codes(n), undo_blocks(n, env=""), *ADDRESSES[n]) for n in ADDRESSES]
    return spark.createDataFrame(rows, "tick string, net string, network string, chain_code int, net_code int, undo_blocks int, pubkey_hash int, script_hash int, bech32 string")


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def without_notes(value):
    """A deep copy without keys that begin with `$`."""
    if isinstance(value, dict):
        return {k: without_notes(v) for k, v in value.items() if not k.startswith("$")}
    return [without_notes(v) for v in value] if isinstance(value, list) else copy.deepcopy(value)


def consensus_subset(config: CoinConfig) -> dict:
    """What nodes of one network must agree on."""
    return without_notes(asdict(config))


def consensus_hash(config: CoinConfig) -> str:
    return hashlib.sha256(canonical_json(consensus_subset(config)).encode()).hexdigest()


def verify_pin(config: CoinConfig, pin: str | None) -> None:
    """Raises if the configuration isn't the pinned one; no pin, no check."""
    if pin is not None and consensus_hash(config) != pin:
        raise ValueError(f"consensus parameters of {config.tick} {config.network} differ from the pin")


def verify_defaults(network: str, chain: bool | None = None, merkle: bool | None = None) -> tuple[bool, bool]:
    """(chain, merkle) checks of a bulk run: on for mainnet unless set; merkle needs chain."""
    merkle = network.endswith("mainnet") if merkle is None else merkle
    return (network.endswith("mainnet") if chain is None else chain) or merkle, merkle

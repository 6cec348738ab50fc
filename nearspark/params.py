"""Parameter rules, checked when a plan is built (before any job runs)."""

from __future__ import annotations

METHODS = ("simhash", "minhash_lsh", "latent_semantic")


def check_simhash(num_bits: int, hamming_threshold: int) -> None:
    if not isinstance(num_bits, int) or num_bits <= 0:
        raise ValueError("num_bits must be a positive integer")
    if not isinstance(hamming_threshold, int) or hamming_threshold < 0:
        raise ValueError("hamming_threshold must be a non-negative integer")


def check_minhash(num_hashes: int, num_bands: int, jaccard_threshold: float | None = None) -> int:
    """Validate MinHash/LSH parameters and return rows per band."""
    if not isinstance(num_hashes, int) or num_hashes <= 0:
        raise ValueError("num_hashes must be a positive integer")
    if not isinstance(num_bands, int) or num_bands <= 0:
        raise ValueError("num_bands must be a positive integer")
    if jaccard_threshold is not None and not (0 <= jaccard_threshold <= 1):
        raise ValueError("jaccard_threshold must be between 0 and 1")
    rows = num_hashes // num_bands
    if rows == 0:
        # Every band would be empty, every document would share every bucket and
        # detection would compare all pairs. Refused instead of run.
        raise ValueError("num_bands must not exceed num_hashes (rows per band would be 0)")
    return rows


def check_lsa(n_components: int, cosine_threshold: float) -> None:
    if not isinstance(n_components, int) or n_components <= 0:
        raise ValueError("n_components must be a positive integer")
    check_unit_threshold(cosine_threshold, "cosine_threshold")


def check_unit_threshold(value: float, name: str = "threshold") -> None:
    if not (0 <= value <= 1):
        raise ValueError(f"{name} must be between 0 and 1")


def check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")

"""Imports every query module so the registry is complete."""

from furrow.plans import q_chat, q_eval, q_models, q_prep, q_profile, q_retrieval, q_stream, q_text  # noqa: F401
from furrow.plans.registry import REGISTRY

__all__ = ["REGISTRY"]

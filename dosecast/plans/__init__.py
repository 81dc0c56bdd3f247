"""Whole flows: prompts, embedding, feature tables, model runs, search."""

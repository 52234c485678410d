"""Recipes of the supported document families and the end-to-end plan."""

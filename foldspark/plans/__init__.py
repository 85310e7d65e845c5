"""Specs, typed nodes, recipes, the runner, artifacts and their inspection."""

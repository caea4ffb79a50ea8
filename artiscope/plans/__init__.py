"""Plans: whole queries made of operators."""

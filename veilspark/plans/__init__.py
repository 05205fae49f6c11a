"""Plans: what a builder records, and how it becomes DataFrames with sensitivities."""

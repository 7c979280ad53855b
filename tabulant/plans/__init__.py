"""The three ways in: load a dataset, explore a view of it, analyse a pair of fields."""

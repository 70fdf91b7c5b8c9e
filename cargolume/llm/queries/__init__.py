"""One module per operator: its registered query over the whole table, and its SQL where SQL can say it."""

"""Named queries over the tables of a data folder, with their SQL where SQL can express them."""

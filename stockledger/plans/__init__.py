"""Plans: the medallion refresh and the query registry."""

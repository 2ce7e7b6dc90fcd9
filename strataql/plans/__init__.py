"""From syntax trees to Spark SQL: names, types and the rewrites that Spark needs."""

"""Named queries over the trade tables, each with the SQL that checks it."""

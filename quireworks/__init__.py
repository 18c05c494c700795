"""quireworks: turning a corpus of plain-text books into structured, queryable tables on Spark."""

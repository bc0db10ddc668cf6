"""symgraph.sources"""
